"""Benchmark decontamination by latent semantic retrieval.

1. Words (lower-cased, outer punctuation stripped) become 64-bit hashes. Their top BITS bits, terms, are written once per
   document for the passes that build the latent space. Document frequencies over all documents give the idf.
2. A randomised SVD of the TF-IDF matrix A of all passages of BLOCK words: each task multiplies its passages into
   A'(A R), R a random start; slices of the product are summed by a shuffle. Its left singular vectors span the
   leading right singular directions of A (one step of subspace iteration), a matrix of 2^BITS rows whatever the
   corpus holds. Directions of hardly any spread are noise and left out. Of the others the first, SKIP of every SKIP + RANK
   and at most SKIP, which tell languages apart and little else, are left out too, and the next RANK are scaled to like
   spread.
3. Benchmark items are searched for in windows of about their own length with a step of about a quarter of a window; items
   longer than the longest window by overlapping parts of that length, whose hits say where the item would start. A window's
   latent vector is a difference of running sums. Windows with a cosine of at least MIN_COSINE that share SHARED of the
   part's number of words with the item are candidates. So are, whatever their cosine, places where runs of GRAM words of
   the item stand in the item's order, if the item's length of words from there shares SHARED of them.
4. For a candidate the longest common subsequence of words, by all 64 bits, must cover MIN_LCS of the item within a stretch of the
   document little longer than the item. Where it covers less than SURE_LCS, the item's answer (its last ANSWER words) must
   be covered to MIN_ANSWER, so paraphrases by insertion, deletion and replacement and items cut off at either end are
   confirmed, and texts of the same topic are not.

Items are searched for in blocks of about ITEMS parts. Each block is one pass over all texts whose hits are written before the next
block is broadcast, so driver and tasks hold one block however many items there are.

Defined results
- Null text counts as empty; items without words, or with a null id, match nothing; equal items all match.
- A document shorter than the window is one window. Repeated rows are each returned. What is found depends on the text alone; rows
  are told apart by doc_id and a 64-bit hash of the text.
- Empty tables give documents without matches, or no documents. Only the named columns are read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, free_name

BITS, SKIP, RANK, EXTRA, BLOCK, SLICE, SEED = 14, 8, 32, 8, 64, 256, 11
#: Windows as (words, step), both in whole UNITs.
UNIT, WINDOWS, ITEMS = 4, ((4, 4), (8, 4), (12, 4), (16, 4), (20, 4), (28, 8), (36, 8), (48, 12)), 2048
MIN_COSINE, SHARED, MIN_LCS, SURE_LCS, ANSWER, MIN_ANSWER = 0.65, 0.4, 0.6, 0.75, 6, 0.5
#: Share of the largest spread under which a direction is rounding noise.
LEAST_SPREAD = 1e-5
#: Words of a run, and the bits of a first look whether any item has it.
GRAM, SEEN_BITS = 3, 22
#: Bytes that part words count as blanks, A-Z as a-z.
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_BYTES[[9, 10, 11, 12, 13, 32, *b".,;:!?\"'()[]|"]] = 0
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.full(1 << 16, _BASE, dtype=np.uint64)
_POWERS[0] = 1
_POWERS = np.cumprod(_POWERS, dtype=np.uint64)


def _long_word(data: np.ndarray) -> np.ndarray:
    """One word's polynomial, raised like all others: the sums of its pieces, each raised by the length of those before."""
    most = len(_POWERS) - 1
    total, raised = np.zeros(1, dtype=np.uint64), _POWERS[most:].copy()
    for k in range(0, len(data), most):
        piece = data[k : k + most].astype(np.uint64) + np.uint64(1)
        total += raised * (piece * _POWERS[: len(piece)]).sum(dtype=np.uint64)
        raised = raised * _POWERS[most:]
    return total


def word_ids(texts: list[str | None], start: int | None = None) -> list[np.ndarray]:
    """uint64 hashes of each text's words, or of their first `start` bytes, in order: a polynomial hash, found for all words of a piece at once."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = _BYTES[np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], data != 0])))
    starts, ends = edge[0::2], edge[1::2]
    out = np.zeros(len(starts), dtype="<u8")
    k, most = 0, len(_POWERS) - 1
    while k < len(starts):
        last = max(int(np.searchsorted(ends, starts[k] + most, side="right")), k + 1)
        lo, hi = int(starts[k]), int(min(ends[last - 1], starts[k] + most))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * _POWERS[: hi - lo], dtype=np.uint64)])
        s, e = starts[k:last] - lo, np.minimum(ends[k:last], hi) - lo
        e = e if start is None else np.minimum(e, s + start)
        h = (sums[e] - sums[s]) * _POWERS[most - s]  # every word's sum raised to the same power
        if hi < ends[k] and start is None:  # one word longer than a piece
            h = _long_word(data[starts[k] : ends[k]])
        h ^= h >> np.uint64(29)
        out[k:last] = h * np.uint64(0xBF58476D1CE4E5B9)
        k = last
    cuts = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in raw])[:-1]) if raw else []
    return np.split(out, cuts) if raw else []


def terms(words: np.ndarray) -> np.ndarray:
    """uint16: the top BITS of words' hashes."""
    return (words >> np.uint64(64 - BITS)).astype("<u2")


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of a long integer."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        if m := at.get(y):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def hashed_words(texts: DataFrame, of=terms) -> DataFrame:
    """texts (id, text) -> id, ids: each text's terms, or what else `of` makes of its words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = [], b.column(1)
            for k in range(0, len(texts), 256):
                ids += [of(x).tobytes() for x in word_ids(texts[k : k + 256].to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    return durable(texts.mapInArrow(run, "id long, ids binary"), "word_ids")


def _arrays(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype="<u2") for x in b.column(b.num_columns - 1)]


def _runs(docs: list[np.ndarray], most: int = 1 << 14) -> Iterator[list[np.ndarray]]:
    """Documents that have words, about so many words at a time."""
    some, n = [], 0
    for x in docs:
        if len(x):
            some.append(x)
            n += len(x)
        if n >= most:
            yield some
            some, n = [], 0
    if some:
        yield some


def _summed(rows: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Rows of (slice, binary vector) summed by slice; at most 2^BITS / SLICE rows come back."""
    n = (1 << BITS) // SLICE

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = np.frombuffer(x.as_buffer(), dtype=kind)
                total[k] = total[k] + part if k in total else part.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "part"])

    got = rows.repartition(n, "slice").mapInArrow(add, "slice int, part binary").collect()
    return {r.slice: np.frombuffer(r.part, dtype=kind) for r in got}


def _slices(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts = [total[k : k + SLICE].tobytes() for k in range(0, 1 << BITS, SLICE)]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["slice", "part"])


def inverse_frequency(ids: DataFrame) -> np.ndarray:
    """float32 idf of each id, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, has = np.zeros((1 << BITS, 2), dtype=np.int64), np.zeros(1 << BITS, dtype=np.int64)
        for b in batches:
            for x in _arrays(b):
                has[x] = 1
                df[:, 0] += has
                has[x] = 0
            df[0, 1] += b.num_rows
        yield from _slices(df)

    got = _summed(ids.select("ids").mapInArrow(run, "slice int, part binary"), "<i8")
    df = np.zeros((1 << BITS, 2), dtype=np.int64)
    for k, x in got.items():
        df[k * SLICE : (k + 1) * SLICE] = x.reshape(-1, 2)
    return np.log((df[0, 1] + 1) / (df[:, 0] + 1)).astype(np.float32) + np.float32(1e-3)


def _add_by_word(total: np.ndarray, words: np.ndarray, y: np.ndarray, of: np.ndarray) -> None:
    """total[word] += y[of] for every word: the n-th occurrences of all words at once, frequent words one by one."""
    order = np.argsort(words, kind="stable")
    ordered = words[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    count = np.diff(np.append(first, len(ordered)))
    often = count > 24
    for n in range(24):
        at = first[(count > n) & ~often] + n
        total[ordered[at]] += y.take(of[order[at]], axis=0)
    for s, n in zip(first[often], count[often], strict=True):
        total[ordered[s]] += y.take(of[order[s : s + n]], axis=0).sum(axis=0)


def latent_basis(ids: DataFrame, idf: np.ndarray) -> np.ndarray:
    """float32[2^BITS, RANK]: scaled directions from A'(A R) over all passages."""
    width = SKIP + RANK + EXTRA
    start = np.random.default_rng(SEED).standard_normal((1 << BITS, width)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weighted = np.zeros((1 << BITS, width), dtype=np.float32), start * idf[:, None]
        for b in batches:
            for some in _runs(_arrays(b), 1 << 16):
                words = np.concatenate(some)
                sizes = [len(x) for x in some]
                ends = np.cumsum(sizes)
                cuts = np.concatenate([np.arange(s - n, s, BLOCK) for s, n in zip(ends, sizes, strict=True)])
                y = np.add.reduceat(weighted.take(words, axis=0), cuts, axis=0) / np.add.reduceat(idf[words] ** 2, cuts)[:, None]
                of = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, len(words))))
                _add_by_word(total, words, y, of)
        total *= idf[:, None]
        yield from _slices(total)

    got = _summed(ids.select("ids").mapInArrow(run, "slice int, part binary"), "<f4")
    b = np.zeros((1 << BITS, width), dtype=np.float64)
    for k, x in got.items():
        b[k * SLICE : (k + 1) * SLICE] = x.reshape(-1, width)
    return directions(b)


def directions(b: np.ndarray) -> np.ndarray:
    """float32[2^BITS, RANK]: the left singular vectors used, scaled; zeros where the table has fewer."""
    u, spread, _ = np.linalg.svd(b, full_matrices=False)
    real = int((spread > LEAST_SPREAD * spread[0]).sum())
    skip = min(SKIP, real * SKIP // (SKIP + RANK))
    used = min(real - skip, RANK)
    out = np.zeros((len(b), RANK), dtype=np.float32)
    out[:, :used] = u[:, skip : skip + used] / np.sqrt(spread[skip : skip + used])
    return out


def part_starts(n: int) -> list[int]:
    """Where the parts of an item of n words start: half a window or less apart, the last one at the end."""
    longest = WINDOWS[-1][0]
    if n <= longest:
        return [0]
    more = -(-2 * (n - longest) // longest)
    return [(n - longest) * k // more for k in range(more + 1)]


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """uint64 keys of all runs of so many words, without collisions."""
    n = max(len(words) - size + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out << np.uint64(BITS + 1) | words[k : k + n].astype(np.uint64)
    return out


def _seen_at(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(_BASE)) >> np.uint64(64 - SEEN_BITS)


class Searcher:
    """Benchmark items (id, words' hashes) as latent unit vectors of their parts by window length, and as runs of terms."""

    def __init__(self, items: list[tuple[int, np.ndarray]], idf: np.ndarray, basis: np.ndarray):
        self.terms = np.vstack([basis * idf[:, None], np.zeros((1, RANK), dtype=np.float32)])  # the last row pads
        items = [(i, x) for i, x in items if i is not None and len(x)]
        self.words = [x.tolist() for _, x in items]
        self.items = [(i, terms(x).astype(np.int64)) for i, x in items]
        self.lengths = np.array([len(x) for _, x in self.items], dtype=np.int64)
        self.member = np.zeros(((1 << BITS) + 1, len(self.items)), dtype=bool)
        for k, (_, x) in enumerate(self.items):
            self.member[x, k] = True
        parts = [(k, at, x[at : at + WINDOWS[-1][0]]) for k, (_, x) in enumerate(self.items) for at in part_starts(len(x))]
        self.part_of = np.array([k for k, _, _ in parts], dtype=np.int64)
        self.part_at = np.array([at for _, at, _ in parts], dtype=np.int64)
        self.part_lengths = lengths = np.array([len(x) for _, _, x in parts], dtype=np.int64)
        near = np.abs(np.log(np.maximum(lengths, 1))[:, None] - np.log(np.array([w for w, _ in WINDOWS]))[None, :]).argmin(axis=1) if len(lengths) else lengths
        self.by_window = {w: np.flatnonzero(near == k) for k, w in enumerate(WINDOWS)}
        vectors = np.array([self.terms[x].sum(axis=0) for _, _, x in parts], dtype=np.float32).reshape(-1, RANK)
        self.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        self.runs = []
        for size in sorted({min(n, GRAM) for n in self.lengths.tolist()}):
            chosen = [k for k, n in enumerate(self.lengths) if min(n, GRAM) == size]
            grams = [_grams(self.items[k][1], size) for k in chosen]
            keys = np.concatenate(grams)
            order = np.argsort(keys, kind="stable")
            of = np.repeat(np.array(chosen), [len(g) for g in grams])[order]
            at = np.concatenate([np.arange(len(g)) for g in grams])[order]
            seen = np.zeros(1 << SEEN_BITS, dtype=bool)
            seen[_seen_at(keys)] = True
            self.runs.append((size, keys[order], of, at, seen))

    def candidates(self, docs: list[np.ndarray]) -> dict[tuple[int, int], list[int]]:
        """(document, item number) -> where the item would start by windows that are near it, or near a part of it."""
        units = np.array([-(-len(x) // UNIT) for x in docs])
        offsets = np.cumsum(units) - units
        words = np.full(int(units.sum()) * UNIT, 1 << BITS, dtype=np.uint16)
        for x, o in zip(docs, offsets * UNIT, strict=True):
            words[o : o + len(x)] = x
        sums = np.zeros((len(words) // UNIT + 1, RANK), dtype=np.float32)
        np.cumsum(np.ones(UNIT, dtype=np.float32) @ self.terms.take(words, axis=0).reshape(-1, UNIT, RANK), axis=0, out=sums[1:])
        found: dict[tuple[int, int], list[int]] = {}
        for (w, step), members in self.by_window.items():
            if not len(members):
                continue
            wide, step = w // UNIT, step // UNIT
            many = np.maximum(-(-(units - wide) // step), 0) + 1
            of = np.repeat(np.arange(len(docs)), many)
            starts = offsets[of] + step * (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many))
            x = sums[np.minimum(starts + wide, (offsets + units)[of])] - sums[starts]
            x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
            s, k = np.divmod(np.flatnonzero(x @ self.vectors[members].T >= MIN_COSINE), len(members))
            if len(s):
                k = members[k]
                at = np.minimum(starts[s][:, None] * UNIT + np.arange(w), len(words) - 1)
                good = self.member[words[at], self.part_of[k][:, None]].sum(axis=1) >= SHARED * np.minimum(self.part_lengths[k], w)
                for i, part in zip(s[good].tolist(), k[good].tolist(), strict=True):
                    start = int(starts[i] - offsets[of[i]]) * UNIT - int(self.part_at[part])
                    found.setdefault((int(of[i]), int(self.part_of[part])), []).append(start)
        return found

    def run_starts(self, docs: list[np.ndarray]) -> dict[tuple[int, int], list[int]]:
        """(document, item number) -> where the item would start by runs of its words, in its order and close together."""
        words, sizes = np.concatenate(docs), np.array([len(x) for x in docs])
        ends = np.cumsum(sizes)
        found: dict[tuple[int, int], list[int]] = {}
        for size, keys, item, at, seen in self.runs:
            grams = _grams(words, size)
            p = np.flatnonzero(seen[_seen_at(grams)])
            of = np.searchsorted(ends, p, side="right")
            p, of = (x[p + size <= ends[of]] for x in (p, of))
            lo, hi = (np.searchsorted(keys, grams[p], side=side) for side in ("left", "right"))
            many = hi - lo
            which = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            k, start = item[which], np.repeat(p, many) - at[which]
            rows, count = np.unique(np.stack([np.repeat(of, many), k, start]), axis=1, return_counts=True)
            rows = rows[:, count >= np.maximum((self.lengths[rows[1]] - size + 1) // 8, 1)]
            for d, i, s in rows.T.tolist():
                begin, n = int(ends[d] - sizes[d]), int(self.lengths[i])
                if self.member[words[max(s, begin) : min(s + n, ends[d])], i].sum() >= SHARED * n:
                    found.setdefault((d, i), []).append(s - begin)
        return found

    def confirmed(self, docs: list[np.ndarray]) -> list[list[tuple[int, float]]]:
        """For each document, given as its words' hashes, (item_id, covered share) of the items that it holds."""
        out, small = [[] for _ in docs], [terms(x) for x in docs]
        near, runs = self.candidates(small), self.run_starts(small)
        for d, k in near.keys() | runs.keys():
            item_id, a, best, words = self.items[k][0], self.words[k], 0.0, docs[d]
            n = len(a)
            tail, last = a[-ANSWER:], None
            stretches = [(s - n // 2, s + n + n // 2) for s in runs.get((d, k), [])]
            for s in sorted(near.get((d, k), [])):
                if last is None or s - last > n // 8 or n <= WINDOWS[-1][0]:  # hits of parts that say the same
                    stretches.append((s - n // 2 - 4, s + n + n // 2 + 20))
                    last = s
            for lo, hi in stretches:
                b = words[max(lo, 0) : max(hi, 0)].tolist()
                covered = lcs(a, b) / n
                if covered > best and (covered >= SURE_LCS or covered >= MIN_LCS and lcs(tail, b) >= MIN_ANSWER * len(tail)):
                    best = covered
            if best:
                out[d].append((item_id, best))
        return [sorted(x) for x in out]


HITS = "doc_id long, t long, item_id long, covered double"


def search(texts: DataFrame, searcher: Broadcast) -> DataFrame:
    """texts (doc_id, t, text) -> a row for each item that a text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, names = searcher.value, [x.split()[0] for x in HITS.split(", ")]
        for b in batches:
            for k in range(0, b.num_rows, 256):
                words = word_ids(b.column(2)[k : k + 256].to_pylist())
                some = [i for i, x in enumerate(words) if len(x)]
                rows = (r for run in _runs(words) for r in s.confirmed(run))
                hits = [(k + i, item, c) for i, r in zip(some, rows, strict=True) for item, c in r]
                at = pa.array([h[0] for h in hits], pa.int64())
                found = [b.column(0).take(at), b.column(1).take(at), pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.float64())]
                yield pa.RecordBatch.from_arrays(found, names)

    return texts.mapInArrow(run, HITS)


def _blocks(benchmark: DataFrame, item_block: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items' words, about item_block parts at a time; no more come to the driver at once."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    block, parts = [], 0
    for r in hashed_words(items.filter("item_id is not null"), lambda x: x).toLocalIterator():
        block.append((r["id"], np.frombuffer(r["ids"], "<u8")))
        parts += len(part_starts(len(block[-1][1])))
        if parts >= item_block:
            yield block
            block, parts = [], 0
    if block:
        yield block


def item_hits(texts: DataFrame, benchmark: DataFrame, item_block: int = ITEMS) -> DataFrame:
    """texts (doc_id, t, text) -> doc_id, t, items: array<struct<item_id, covered>>; only of texts that hold some."""
    spark = texts.sparkSession
    ids = hashed_words(texts.select("t", "text"))
    idf = inverse_frequency(ids)
    basis = latent_basis(ids, idf)
    discard(ids)
    hits = None
    for block in _blocks(benchmark, item_block):
        searcher = spark.sparkContext.broadcast(Searcher(block, idf, basis))  # of about item_block parts of items
        found = durable(search(texts, searcher), "item_hits")
        searcher.destroy()
        hits = found if hits is None else hits.union(found)
    if hits is None:
        hits = texts.select("doc_id", "t", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("covered")).limit(0)
    hits = hits.groupBy("doc_id", "t", "item_id").agg(F.max("covered").alias("covered"))
    return hits.groupBy("doc_id", "t").agg(F.sort_array(F.collect_list(F.struct("item_id", "covered"))).alias("items"))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def find_items(docs: DataFrame, benchmark: DataFrame, item_block: int = ITEMS) -> DataFrame:
    """doc_id, items: array<struct<item_id, covered>>; one row for each row of docs."""
    texts = _texts(docs)
    hits = item_hits(texts, benchmark, item_block).select(F.struct("doc_id", "t").alias("__hit"), "items")
    rows = texts.select("doc_id", F.struct("doc_id", "t").alias("__key"))
    rows = rows.join(durable(hits, "held_items"), F.col("__key") == F.col("__hit"), "left")
    return rows.select("doc_id", F.coalesce("items", F.array().cast("array<struct<item_id:bigint,covered:double>>")).alias("items"))


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids: array<long>, covered: the largest share of an item."""
    return find_items(docs, benchmark).select(
        "doc_id",
        (F.size("items") > 0).alias("contaminated"),
        F.size("items").cast("long").alias("n_items"),
        F.sort_array(F.transform("items", lambda x: x["item_id"])).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("items", lambda x: x["covered"])), F.lit(0.0)).alias("covered"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all columns, that hold no benchmark item. Each row's own text decides, whatever its doc_id."""
    hits = durable(item_hits(_texts(docs), benchmark).select(F.struct("doc_id", "t").alias("__hit")), "contaminated")
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    name = free_name(docs, "__key")
    marked = docs.withColumn(name, key)
    return marked.join(hits, marked[name] == hits["__hit"], "left_anti").drop(name)
