"""Document quality by hierarchical empirical Bayes.

A logistic regression on hashed words, their first bytes, and a few style measures, fitted on at most MAX_LEARN labelled documents by
keyed hash, gives every document its own evidence for two traits: quality and toxic. Evidence is summed by path and
by host (pre-aggregated, so a hot host costs no more than others). Host posteriors shrink toward the global mean, path posteriors
toward their host; how strongly is estimated from the spread of the means themselves by the method of moments, so
sparse sites lean on their prior. A document's posterior adds the log-odds of its path, relative to the global
mean, to its own log-odds, weighted by SITE_WEIGHT. Its own evidence is taken out of its path's and host's sums first, so it
counts once: alone on its path, a document meets its host's posterior, and alone on its host the global mean.

Defined results
- Null text counts as empty. Null host and path are sites of their own.
- Without labels of a trait its evidence is PRIOR for every document. Null labels are not learned from.
- Of a doc_id's labels the largest of each trait counts; of its texts the one least by hash is learned from.
- Repeated rows are each returned and each counted. An empty table gives an empty result.
- Only the named columns are read, so other columns may have any name.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, keep_rows
from .decontaminate import word_ids

TRAITS = ("quality", "toxic")
BITS, MAX_LEARN, FEATURES, LEAST_DOCS, RIDGE, STEPS, TOLERANCE = 18, 6000, 4000, 4, 1.0, 100, 1e-5
SITE_WEIGHT, PRIOR, MOST_SHRINK = 0.25, 0.5, 1e6
_ASCII = np.zeros(256, dtype=np.int64)
_ASCII[65:91], _ASCII[48:58], _ASCII[97:123], _ASCII[128:] = 1, 2, 3, 4
_ASCII[[9, 10, 11, 12, 13, 32]] = 5
STYLE = 7
#: Bytes of a word's start, and what tells its hash from a whole word's.
START, _OTHER = 6, np.uint64(0x94D049BB133111EB)


def features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the sorted hashed ids of its words and of their starts, and STYLE measures between about 0 and 1."""
    out = []
    for k in range(0, len(texts), 256):
        some = texts[k : k + 256]
        for text, words, starts in zip(some, word_ids(some), word_ids(some, START), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            kinds = np.unique(words)
            of = np.bincount(_ASCII[np.frombuffer(data, dtype=np.uint8)], minlength=6)
            n, m = max(len(data), 1), max(len(words), 1)
            lines = data.split(b"\n")
            style = [of[1] / n, of[2] / n, of[0] / n, min(len(data) / m, 40) / 40, len(kinds) / m, len(set(lines)) / len(lines), min(math.log1p(m) / 12, 1)]
            ids = np.unique(np.concatenate([kinds, np.unique(starts) ^ _OTHER]) >> np.uint64(64 - BITS)).astype(np.int64)
            out.append((ids, np.array(style, dtype=np.float64)))
    return out


class Classifier:
    """Logistic weights over chosen word ids and style measures."""

    def __init__(self, chosen: np.ndarray, words: np.ndarray, style: np.ndarray, mean: np.ndarray, scale: np.ndarray, bias: float):
        self.chosen, self.words, self.style, self.mean, self.scale, self.bias = chosen, words, style, mean, scale, bias

    def probability(self, ids: np.ndarray, style: np.ndarray) -> float:
        at = np.searchsorted(self.chosen, ids)
        at = at[(at < len(self.chosen))]
        hit = at[np.isin(self.chosen[at], ids)]
        x = self.bias + self.words[hit].sum() + ((style - self.mean) / self.scale) @ self.style
        return 1 / (1 + math.exp(-min(max(x, -30), 30)))


def least(f, w: np.ndarray) -> np.ndarray:
    """Where f, which gives value and slope, is least: limited-memory BFGS from w, at most STEPS steps."""
    value, slope = f(w)
    past: list[tuple] = []
    for _ in range(STEPS):
        d, alphas = -slope, []
        for s, y, r in reversed(past):
            alphas.append(r * (s @ d))
            d = d - alphas[-1] * y
        d = d * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(np.linalg.norm(slope), 1.0))
        for (s, y, r), a in zip(past, reversed(alphas), strict=True):
            d = d + s * (a - r * (y @ d))
        step = 1.0
        while step > 1e-6 and (found := f(w + step * d))[0] > value + 1e-4 * step * (slope @ d):
            step /= 2
        if step <= 1e-6:
            break
        s, y = step * d, found[1] - slope
        w, (value, slope) = w + s, found
        if s @ y > 1e-12:
            past = [*past, (s, y, 1 / (s @ y))][-10:]
        if np.linalg.norm(slope) < TOLERANCE * max(np.linalg.norm(w), 1.0):
            break
    return w


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Classifier | None:
    if len(set(y.tolist())) < 2:
        return None
    ones, zeros = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for (ids, _), label in zip(rows, y, strict=True):
        (ones if label else zeros)[ids] += 1
    a, b = (ones + 0.5) / (y.sum() + 1), (zeros + 0.5) / ((1 - y).sum() + 1)
    spread = np.where(ones + zeros >= LEAST_DOCS, (a - b) ** 2 / (a + b), -1.0)
    chosen = np.sort(np.argsort(-spread, kind="stable")[:FEATURES])
    chosen = chosen[spread[chosen] >= 0]
    style = np.array([s for _, s in rows])
    mean, scale = style.mean(axis=0), np.maximum(style.std(axis=0), 1e-3)
    x = np.ones((len(rows), len(chosen) + STYLE + 1), dtype=np.float32)
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    x[:, : len(chosen)] = 0
    for k, (ids, _) in enumerate(rows):
        at = place[ids]
        x[k, at[at >= 0]] = 1
    x[:, len(chosen) : -1] = (style - mean) / scale
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    ridge = np.full(x.shape[1], RIDGE / len(y))
    ridge[-1] = 0

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = (x @ w.astype(np.float32)).astype(np.float64)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        of = weight * (np.logaddexp(0, z) - y * z)
        return of.sum() + ridge @ w**2 / 2, ((weight * (p - y)).astype(np.float32) @ x).astype(np.float64) + ridge * w

    w = least(loss, np.zeros(x.shape[1]))
    n = len(chosen)
    return Classifier(chosen, w[:n], w[n:-1], mean, scale, float(w[-1]))


def learn(docs: DataFrame, labels: DataFrame) -> list[Classifier | None]:
    """A classifier for each trait, from a bounded sample of labelled documents."""
    some = labels.filter("doc_id is not null").groupBy("doc_id").agg(*[F.max(t).alias(t) for t in TRAITS])
    some = some.filter(" or ".join(f"{t} is not null" for t in TRAITS))
    some = some.orderBy(F.xxhash64(F.lit("learn"), "doc_id"), "doc_id").limit(MAX_LEARN)
    said = {r.doc_id: [r[t] for t in TRAITS] for r in some.collect()}
    if not said:
        return [None] * len(TRAITS)
    ids = docs.sparkSession.createDataFrame([(d,) for d in sorted(said)], "doc_id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = features(b.column(2).to_pylist())
            parts = [pa.array([f[0].astype("<i4").tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *parts], ["doc_id", "t", "ids", "style"])

    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    texts = keep_rows(texts, F.broadcast(ids), ["doc_id"])  # of at most MAX_LEARN ids
    rows = texts.mapInArrow(run, "doc_id long, t long, ids binary, style binary").groupBy("doc_id").agg(F.min_by(F.struct("ids", "style"), "t").alias("f"))
    got = {r.doc_id: (np.frombuffer(r.f.ids, "<i4").astype(np.int64), np.frombuffer(r.f.style)) for r in rows.collect()}
    out = []
    for k in range(len(TRAITS)):
        use = [d for d in sorted(got) if said[d][k] is not None]
        out.append(fit([got[d] for d in use], np.array([float(said[d][k]) for d in use])) if use else None)
    return out


def evidence(docs: DataFrame, models: list[Classifier | None], host: str, path: Column) -> DataFrame:
    """doc_id, host, path and p_<trait> for each trait."""
    names = ["doc_id", "host", "path", *[f"p_{t}" for t in TRAITS]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = features(b.column(3).to_pylist())
            ps = [pa.array([m.probability(*f) if m else PRIOR for f in found], pa.float64()) for m in models]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *ps], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), path.cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, host string, path string, " + ", ".join(f"p_{t} double" for t in TRAITS))


def _strengths(groups: DataFrame, prior: dict[str, Column]) -> dict[str, float]:
    """Prior strength of each trait by the method of moments over groups with n and s_<trait>: one row comes back."""
    n, of = F.col("n"), []
    for t in TRAITS:
        q = prior[t]
        of += [F.sum(n * (F.col(f"s_{t}") / n - q) ** 2).alias(f"spread_{t}"), F.sum(q * (1 - q)).alias(f"noise_{t}"), F.sum(n * q * (1 - q)).alias(f"base_{t}")]
    r, out = groups.agg(F.sum("n").alias("n"), *of).first(), {}
    for t in TRAITS:
        between = ((r[f"spread_{t}"] or 0) - (r[f"noise_{t}"] or 0)) / (r["n"] or 1)
        base = (r[f"base_{t}"] or 0) / (r["n"] or 1)
        out[t] = min(max(base / between - 1, 1.0), MOST_SHRINK) if between > 0 else MOST_SHRINK
    return out


def _shrunk(prior: Column, strength: float, total: Column, n: Column) -> Column:
    return (strength * prior + total) / (strength + n)


def site_posteriors(rows: DataFrame) -> DataFrame:
    """host, path, for each trait all_, host_ and path_<trait>, and what they are made of: n and s_ of the path, host_n and
    host_s_ of the host, k_host_ and k_path_. One row per path."""
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(f"p_{t}").alias(f"s_{t}") for t in TRAITS])
    paths = durable(paths, "quality_paths")
    hosts = durable(paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(f"s_{t}").alias(f"s_{t}") for t in TRAITS]), "quality_hosts")
    whole = hosts.agg(*[(F.sum(f"s_{t}") / F.sum("n")).alias(t) for t in TRAITS]).first()
    mean = {t: F.lit(whole[t] if whole[t] is not None else PRIOR) for t in TRAITS}
    host_k = _strengths(hosts, mean)
    hosts = hosts.select(F.col("host").alias("__host"), F.col("n").alias("host_n"), *[F.col(f"s_{t}").alias(f"host_s_{t}") for t in TRAITS])
    out = paths.join(hosts, paths["host"].eqNullSafe(hosts["__host"])).drop("__host")
    out = out.select("*", *[_shrunk(mean[t], host_k[t], F.col(f"host_s_{t}"), F.col("host_n")).alias(f"host_{t}") for t in TRAITS])
    out = durable(out, "quality_nested")
    path_k = _strengths(out, {t: F.col(f"host_{t}") for t in TRAITS})
    path = [_shrunk(F.col(f"host_{t}"), path_k[t], F.col(f"s_{t}"), F.col("n")).alias(f"path_{t}") for t in TRAITS]
    known = [F.lit(k[t]).alias(f"k_{of}_{t}") for of, k in (("host", host_k), ("path", path_k)) for t in TRAITS]
    return out.select("*", *[mean[t].alias(f"all_{t}") for t in TRAITS], *path, *known)


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(q / (1 - q))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: Column | None = None) -> DataFrame:
    """doc_id, host, path, p_, host_, path_ and post_<trait> for each trait, keep."""
    path = F.concat_ws("/", F.col(host), F.col("lang")) if path is None else path
    rows = durable(evidence(docs, learn(docs, labels), host, path), "quality_evidence")
    sites = durable(site_posteriors(rows), "quality_sites").withColumnRenamed("host", "__host").withColumnRenamed("path", "__path")
    out = rows.join(sites, rows["host"].eqNullSafe(sites["__host"]) & rows["path"].eqNullSafe(sites["__path"]))
    for t in TRAITS:  # without the document itself
        own = F.col(f"p_{t}")
        host_of = _shrunk(F.col(f"all_{t}"), F.col(f"k_host_{t}"), F.col(f"host_s_{t}") - own, F.col("host_n") - 1)
        path_of = _shrunk(host_of, F.col(f"k_path_{t}"), F.col(f"s_{t}") - own, F.col("n") - 1)
        odds = _logit(own) + SITE_WEIGHT * (_logit(path_of) - _logit(F.col(f"all_{t}")))
        out = out.withColumn(f"post_{t}", 1 / (1 + F.exp(-odds)))
    keep = (F.col("post_quality") >= 0.5) & (F.col("post_toxic") < 0.5)
    return out.select("doc_id", "host", "path", *[f"{a}_{t}" for t in TRAITS for a in ("p", "host", "path", "post")], keep.alias("keep"))
