"""Language identification with string kernels.

Two texts are compared by the blended spectrum of their character n-grams (n = 1, 2, 3, present or absent):
k(x, y) = |X and Y| / sqrt(|X| |Y|). Landmark texts give a Nyström map, and one-versus-rest kernel ridge
regression is fitted on a bounded sample of labelled texts: by keyed hash LEARN_PER_LANG of each language, or as many of each as
MAX_LEARN in all allows, of the MAX_LANGS most frequent languages. Landmarks are the first of each language, MAX_LANDMARKS in all.
What the driver gathers are packed presence bits of that sample, 2 KB a text, never texts; it unpacks CHUNK of them at a time.

Scores of a batch of texts are a matrix product. As (X L') a = X (L' a), with L the landmarks' normalised
presence rows and a the regression's weights, L' a is multiplied out once and every text meets a matrix of one
column per language.

Defined results
- Null text, or one without a letter, is `und` with score 0; so is everything if nothing can be learned.
- Only text is an input of a prediction; a null doc_id counts as the empty text for the fold.
- Rows without lang or text are never learned from; equal rows are learned from once and each returned. Rows of one doc_id are told
  apart by their text.
- Very long texts are read in pieces whose presence bits are joined. Other columns may have any name. An empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, keep_rows

BITS, SPECTRUM, PIECE = 14, (1, 2, 3), 1 << 20
LEARN_PER_LANG, LANDMARKS_PER_LANG, MAX_LEARN, MAX_LANDMARKS, MAX_LANGS, CHUNK, RIDGE = 400, 64, 8000, 1024, 1000, 512, 0.1
LEAST_SCORE = 0.2
UNKNOWN = "und"
#: Odd multipliers of the n-gram hash.
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def presence(text: str) -> np.ndarray:
    """bool[2^BITS]: which hashed n-grams the lower-cased text has; ASCII other than letters counts as a blank."""
    out = np.zeros(1 << BITS, dtype=bool)
    for k in range(0, max(len(text), 1), PIECE):
        piece = f" {text[max(k - max(SPECTRUM) + 1, 0) : k + PIECE].lower()} "
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
        codes = np.where((codes < 97) | ((codes > 122) & (codes < 128)), np.uint32(32), codes)
        mixed = [codes * m for m in _MULT]
        for n in SPECTRUM:
            if len(codes) >= n:
                h = mixed[0][: len(codes) - n + 1] + np.uint32(n)
                for j in range(1, n):
                    h = (h ^ (h >> np.uint32(15))) * _MULT[3] + mixed[j][j : len(codes) - n + 1 + j]
                h = (h ^ (h >> np.uint32(15))) * _MULT[1]
                out[h >> np.uint32(32 - BITS)] = True
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


class LanguageModel:
    """langs, and the matrix of 2^BITS rows that a text's normalised presence bits are multiplied with."""

    def __init__(self, langs: list[str], weights: np.ndarray):
        self.langs, self.weights = langs, weights

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if self.langs and has_letter(t)]
        for k in range(0, len(known), 256):
            some = known[k : k + 256]
            x = np.zeros((len(some), 1 << BITS), dtype=np.float32)
            for row, i in enumerate(some):
                x[row] = presence(texts[i])
            x /= np.sqrt(x.sum(axis=1, keepdims=True))
            found = x @ self.weights
            for row, i in enumerate(some):
                best = int(found[row].argmax())
                names[i], scores[i] = self.langs[best], float(np.clip(found[row, best], 0.0, 1.0))
        return names, scores


def _normalised(packed: np.ndarray) -> np.ndarray:
    """float32 rows of unit length from packed presence bits."""
    x = np.unpackbits(packed, axis=1).astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def fit(packed: np.ndarray, langs: list[str], landmark: np.ndarray) -> LanguageModel:
    """packed: presence bits of each learned text, langs: theirs, landmark: which of them are landmarks."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((1 << BITS, 0), dtype=np.float32))
    marks = _normalised(packed[landmark])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    z = np.vstack([(_normalised(packed[k : k + CHUNK]) @ marks.T).astype(np.float64) @ root for k in range(0, len(packed), CHUNK)])
    y = np.array([[lang == n for n in names] for lang in langs], dtype=np.float64)
    w = np.linalg.solve(z.T @ z + RIDGE * np.eye(z.shape[1]), z.T @ y)
    return LanguageModel(names, (marks.T @ (root @ w).astype(np.float32)))


def learn(docs: DataFrame, use=None) -> LanguageModel:
    """Learn from documents with text and lang for which `use` holds (all, if not given)."""
    known = docs.filter("lang is not null and text is not null")
    known = known.filter(use) if use is not None else known
    known = known.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.lit("learn"), "doc_id", "text").alias("h"))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    nothing = np.zeros((0, (1 << BITS) // 8), dtype=np.uint8)
    if not sizes:
        return fit(nothing, [], np.zeros(0, dtype=bool))
    most = min(LEARN_PER_LANG, MAX_LEARN // len(sizes))
    # hashes below a share of the range leave a few times as many rows as are picked, however many there are
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(4.0 * (most + 25) / r["count"], 1.0))])
    rows = known.select("lang", "h").filter((F.col("h") / F.lit(2.0**64) + 0.5) <= F.element_at(share, F.col("lang"))).distinct()
    by_lang = Window.partitionBy("lang").orderBy("h")
    picked = rows.withColumn("rank", F.row_number().over(by_lang)).filter(F.col("rank") <= most)
    ranks = {(r.h, r.lang): r["rank"] for r in picked.collect()}
    if not ranks:
        return fit(nothing, [], np.zeros(0, dtype=bool))
    ids = docs.sparkSession.createDataFrame(list(ranks), "h long, lang string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.packbits(presence(t)).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.binary())], ["h", "lang", "bits"])

    rows = keep_rows(known.select("h", "lang", "text"), F.broadcast(ids), ["h", "lang"])  # of at most MAX_LEARN hashes
    got = {(r.h, r.lang): r.bits for r in rows.mapInArrow(run, "h long, lang string, bits binary").dropDuplicates(["h", "lang"]).collect()}
    order = sorted(got, key=lambda k: (ranks[k], k[1], k[0]))
    packed = np.frombuffer(b"".join(got[k] for k in order), dtype=np.uint8).reshape(len(order), -1)
    landmark = np.array([ranks[k] <= LANDMARKS_PER_LANG for k in order]) & (np.arange(len(order)) < MAX_LANDMARKS)
    return fit(packed, [k[1] for k in order], landmark)


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns named in keep, with the predicted language and its score, under `names`, which keep must not have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = model.score(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, *names])

    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")
    return docs.select(*keep, F.col("text").cast("string").alias(free_name(docs, "__text"))).mapInArrow(run, schema)


def language_digest(docs: DataFrame) -> DataFrame:
    model = learn(docs, ~held_out())
    return predict(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])


def keep_known_language(docs: DataFrame) -> DataFrame:
    """Documents whose text is of a learned language with at least LEAST_SCORE."""
    names = free_name(docs, "__lang_pred"), free_name(docs, "__score")
    found = predict(docs, learn(docs), docs.columns, names)
    return found.filter((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= LEAST_SCORE)).drop(*names)
