"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Text is split by a pattern, and each match is encoded by itself: one that the vocabulary holds whole is its id; of any other the
bytes start as tokens, and the neighbours whose joint bytes have the least rank are merged, leftmost first, until no
neighbours have one. A leaf of the tree is a byte position and holds the rank of the pair that starts there, with the position in its
low bits, so that the least value at the root is the least rank's leftmost pair. A merge changes three leaves: the pair that
begins at the merged token, the one before it, and the one that is gone. Each change walks up only as far as minima change. Live
neighbours are kept in two arrays. A match of n bytes so takes n log n steps, however long it is.

Ranks are read from a file on the driver, whose path is a parameter, and broadcast: a vocabulary is of bounded size, checked by
MOST_RANKS. Matches up to CACHED_BYTES are kept by worker with their ids, twice CACHED of them at most.

Defined results
- Null text counts as empty, with no ids; an empty table gives an empty result. Repeated rows are each returned.
- Very long texts are split match by match, and their ids are put together as flat arrays.
- Special tokens' strings are ordinary text. Only the id and text columns are read, so other columns may have any name.
- An id outside the vocabulary, or a null one, raises in decoding; a null array of ids decodes to no bytes.
"""

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

MOST_RANKS, CACHED, CACHED_BYTES, BATCH_IDS = 2_000_000, 1 << 18, 64, 1 << 22
#: Longest text whose matches are listed at once.
LISTED = 1 << 20
#: Above any rank.
NONE = 1 << 62


class Ranks:
    """A vocabulary: ranks of byte strings, each its own id."""

    def __init__(self, ranks: dict[bytes, int]):
        if len(ranks) > MOST_RANKS:
            raise ValueError(f"{len(ranks)} ranks are more than {MOST_RANKS}")
        if any(bytes([x]) not in ranks for x in range(256)):
            raise ValueError("the vocabulary lacks a byte")
        self.ranks, self.longest = ranks, max(map(len, ranks))

    @classmethod
    def read(cls, path: str) -> "Ranks":
        """Lines of base64 bytes and rank."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def pair_tree(pairs: list[int]) -> list[int]:
    """A segment tree of minima: the root at 1, the children of k at 2k and 2k + 1, leaves in the upper half."""
    size = 1 << (len(pairs) - 1).bit_length()
    least = [NONE] * size + pairs + [NONE] * (size - len(pairs))
    for k in range(size - 1, 0, -1):
        a, b = least[2 * k], least[2 * k + 1]
        least[k] = a if a < b else b
    return least


def set_pair(least: list[int], leaf: int, pair: int) -> None:
    """A point update: walks up as far as minima change."""
    least[leaf] = pair
    while leaf > 1:
        other = least[leaf ^ 1]
        if other < pair:
            pair = other
        leaf >>= 1
        if least[leaf] == pair:
            return
        least[leaf] = pair


def merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of a piece of one byte or more."""
    n = len(piece)
    shift, rank_of = n.bit_length(), ranks.get
    low = (1 << shift) - 1
    pairs = [NONE if (rank := rank_of(piece[k : k + 2])) is None else rank << shift | k for k in range(n - 1)] or [NONE]
    least = pair_tree(pairs)
    leaves = len(least) >> 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that starts at a position
    while (found := least[1]) != NONE:
        at = found & low
        gone = after[at]
        end = after[at] = after[gone]
        pair = NONE
        if end < n:
            before[end] = at
            set_pair(least, leaves + gone, NONE)
            if (stop := after[end]) - at <= longest and (rank := rank_of(piece[at:stop])) is not None:
                pair = rank << shift | at
        set_pair(least, leaves + at, pair)
        if (left := before[at]) >= 0:
            rank = rank_of(piece[left:end]) if end - left <= longest else None
            set_pair(least, leaves + left, NONE if rank is None else rank << shift | left)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


class Pieces(dict):
    """Ids of pieces, encoded when they are first asked for. Short ones are kept, and of those kept before what is asked for again."""

    def __init__(self, vocabulary: Ranks):
        super().__init__()
        self.ranks, self.longest, self.before = vocabulary.ranks, vocabulary.longest, {}

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self.before.get(text)
        if ids is None:
            raw = text.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            ids = (whole,) if whole is not None else tuple(merge(raw, self.ranks, self.longest)) if raw else ()
            if len(raw) > CACHED_BYTES:
                return ids
        if len(self) >= CACHED:
            self.before = dict(self)
            self.clear()
        self[text] = ids
        return ids


class Encoder:
    def __init__(self, vocabulary: Ranks, pattern: str):
        self.pattern, self.pieces = regex.compile(pattern), Pieces(vocabulary)

    def encode(self, text: str) -> np.ndarray:
        found = (m.group() for m in self.pattern.finditer(text)) if len(text) > LISTED or self.pattern.groups else self.pattern.findall(text)
        return np.fromiter(chain.from_iterable(map(self.pieces.__getitem__, found)), dtype=np.int32)


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(Ranks.read(path))


def encode(docs: DataFrame, ranks: Broadcast, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> of every whole text; `ranks` is what vocabulary() gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, pattern)
        for b in batches:
            start, found, size = 0, [], 0

            def taken(end: int) -> pa.RecordBatch:
                at = np.concatenate([[0], np.cumsum([len(x) for x in found])])
                ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
                return pa.RecordBatch.from_arrays([b.column(0).slice(start, end - start), ids], ["doc_id", "ids"])

            for i, text in enumerate(b.column(1)):
                found.append(encoder.encode(text.as_py() or ""))
                size += len(found[-1])
                if size > BATCH_IDS:
                    yield taken(i + 1)
                    start, found, size = i + 1, [], 0
            yield taken(b.num_rows)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, rows.select("doc_id").schema.add("ids", ArrayType(IntegerType())))


def decode(encoded: DataFrame, ranks: Broadcast, carried: list[str] | None = None) -> DataFrame:
    """The carried columns (doc_id, if not given) with `bytes`, what ids stand for."""
    carried = carried or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {v: k for k, v in ranks.value.ranks.items()}
        for b in batches:
            ids = b.column(len(carried))
            raw = [b"".join(map(words.__getitem__, (x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, int)).tolist())) for x in ids]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(raw, pa.binary())], [*carried, "bytes"])

    return encoded.select(*carried, F.col("ids").alias("__ids")).mapInArrow(run, encoded.select(*carried).schema.add("bytes", "binary"))


def bpe_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by blanks), decoded_sha256 (of the bytes that the ids decode to)."""
    ranks = vocabulary(docs.sparkSession, path)
    encoded = encode(docs, ranks, pattern)
    said = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    encoded = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), said.alias("ids_sha256"), "ids")
    decoded = decode(encoded, ranks, ["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))
