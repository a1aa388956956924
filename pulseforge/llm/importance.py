"""Importance resampling toward a target distribution over hashed n-grams, with n-grams' CRCs taken from prefix CRCs.

A document is normalised: A-Z lower-cased, words (letters a-z, digits, anything beyond ASCII) joined by one blank. One scan keeps
the running CRC-32 at the start of each word; at its end it is that of the next start taken back by the blank's byte. CRC-32 is linear over GF(2): appending n bytes to a prefix shifts
its state by n bytes, whatever they are, so the CRC of a substring is the CRC of the prefix that ends with it, xor the shifted
CRC of the prefix before it. The shift by n bytes is multiplication by x^(8n) modulo the polynomial, a table of four
times 256 words for each n below SHORT, and longer shifts are put together from those by powers of two. All n-grams
of 1 to MAX_WORDS words so cost two look-ups each, and no n-gram is ever built.

Two passes over the texts take a document's buckets (CRC modulo BUCKETS): one counts by bucket, and each task hands on one row for each
bucket; the other sums the buckets' gains. Nothing of a text's size is written or shuffled. What comes to the driver and is broadcast
are gains, BUCKETS numbers whatever the corpus holds. Gumbel noise keyed by the id makes the highest scores a draw without replacement in
proportion to the exponential of the weight; ranks are dealt by range partitions of slim rows, not by one task.

Defined results
- Null text has no words: no features and weight 0. Documents with fewer than LEAST_WORDS words are never drawn.
- A null id is keyed by the empty string and comes after all others in ties. Rows that repeat an id are each returned and
  ranked; ties between them go by the text's hash.
- Empty tables: no documents give no rows, and an empty benchmark gives gains from the documents alone.
- Very long texts are read in pieces of PIECE words. Only the id and text columns are read, so other columns may have any name.
"""

from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from .common import durable

BUCKETS, MAX_WORDS, LEAST_WORDS, SHARE, SEED = 10_000, 3, 20, 5, 42
SHORT, PIECE = 256, 1 << 16
#: Fixed value: the CRC-32 polynomial, bits reflected.
_POLY = np.uint32(0xEDB88320)
#: Bytes as words see them: A-Z lower-cased, other ASCII but letters and digits a blank.
_NORMAL = bytes(x if x > 127 or chr(x).isalnum() else 32 for x in range(128)).lower() + bytes(range(128, 256))


def _byte_steps() -> np.ndarray:
    """What a byte in the state's lowest place becomes when the state is shifted by one byte."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = (steps >> np.uint32(1)) ^ np.where(steps & np.uint32(1), _POLY, np.uint32(0))
    return steps


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map, given by what it makes of each of a state's four bytes, of states."""
    out = table[0][crc & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ table[k][crc >> np.uint32(8 * k) & np.uint32(255)]
    return out


class Shift:
    """CRC states shifted by any number of zero bytes."""

    def __init__(self) -> None:
        step = _STEPS
        state = np.array([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        tables = [state]
        for _ in range(SHORT - 1):
            state = step[state & np.uint32(255)] ^ (state >> np.uint32(8))
            tables.append(state)
        self.short = [t.ravel() for t in np.stack(tables, axis=1)]  # for each byte of the state, by shift and value
        self.powers = [step[state & np.uint32(255)] ^ (state >> np.uint32(8))]  # by SHORT bytes, then twice as many each

    def _power(self, k: int) -> np.ndarray:
        while len(self.powers) <= k:
            self.powers.append(_apply(self.powers[-1], self.powers[-1]))
        return self.powers[k]

    def __call__(self, crc: np.ndarray, by: np.ndarray) -> np.ndarray:
        low = (by & (SHORT - 1)) << 8
        out = self.short[0].take(low | (crc & np.uint32(255)))
        for k in range(1, 4):
            out ^= self.short[k].take(low | (crc >> np.uint32(8 * k) & np.uint32(255)))
        high, k = by >> SHORT.bit_length() - 1, 0
        while high.any():
            if len(at := np.flatnonzero(high & 1)):
                out[at] = _apply(self._power(k), out[at])
            high, k = high >> 1, k + 1
        return out


#: A byte's step by the highest byte of what it makes, which no two share.
_STEPS = _byte_steps()
_BACK = np.argsort(_STEPS >> np.uint32(24)).astype(np.uint32)


def before_blank(crc: np.ndarray) -> np.ndarray:
    """The CRCs of texts without their last byte, which is a blank, from those of the texts."""
    state = ~crc
    step = _BACK[state >> np.uint32(24)]
    return ~((state ^ _STEPS[step]) << np.uint32(8) | step ^ np.uint32(32))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def ngram_crcs(words: list[bytes], shift: Shift, most: int = MAX_WORDS) -> Iterator[np.ndarray]:
    """uint32 arrays: CRC-32 of every run of 1 to `most` words joined by blanks, repeats included, in pieces."""
    for k in range(0, len(words), PIECE):
        some = words[k : k + PIECE + most - 1]  # runs that begin in this piece may end in the next
        n = min(PIECE, len(words) - k)
        # the CRC up to each word's start, and after the last, and where that is
        spaced = [word + b" " for word in some]
        starts = np.fromiter(accumulate(spaced, lambda crc, word: crc32(word, crc), initial=0), dtype=np.uint32, count=len(some) + 1)
        places = np.concatenate([[0], np.fromiter(map(len, spaced), dtype=np.int64, count=len(some)).cumsum()])
        ends = before_blank(starts[1:])
        for m in range(1, most + 1):
            count = min(n, len(some) - m + 1)
            if count > 0:
                by = places[m : m + count] - 1 - places[:count]
                yield ends[m - 1 : m - 1 + count] ^ shift(starts[:count], by)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, most: int = MAX_WORDS) -> DataFrame:
    """bucket, n: how many features of the texts fall there. A task hands on a row for each bucket that it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, total = Shift(), np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for text in b.column(0):
                for crc in ngram_crcs(words_of(text.as_py()), shift, most):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Counts of both -> bucket, gain: thousandths of the log of target's share over raw's, each count one more."""
    spark = raw.sparkSession
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(target.select("bucket", F.lit(0).cast("long"), "n"))
    both = both.union(spark.range(buckets).select(F.col("id").cast("int"), F.lit(0).cast("long"), F.lit(0).cast("long")))
    both = durable(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "bucket_counts")
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    more = lambda c, k: (F.col(c) + k).cast("double")
    ratio = more("t", 1) * more("all_s", buckets) / (more("s", 1) * more("all_t", buckets))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))  # by one row


def weigh(texts: DataFrame, carried: list[str], gains: Broadcast, buckets: int = BUCKETS, most: int = MAX_WORDS) -> DataFrame:
    """texts (the carried columns, text) -> the carried columns with n_words, n_features and weight, the sum of the features' gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = Shift()
        for b in batches:
            found = []
            for text in b.column(len(carried)):
                words, n, weight = words_of(text.as_py()), 0, 0
                for crc in ngram_crcs(words, shift, most):
                    n += len(crc)
                    weight += int(gains.value[crc % np.uint32(buckets)].sum())
                found.append((len(words), n, weight))
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], [*carried, "n_words", "n_features", "weight"])

    rows = texts.select(*carried, F.col("text").cast("string").alias("__text"))
    return rows.mapInArrow(run, texts.select(*carried).schema.add("n_words", "long").add("n_features", "long").add("weight", "long"))


def noise(seed: int, key: Column) -> Column:
    """Thousandths of Gumbel noise from the first 32 bits of sha256 of `seed:key`."""
    said = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(said, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; `share` in a hundred of those long enough have a rank."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    found = bucket_gains(bucket_counts(texts, "text", buckets), bucket_counts(target, target_text, buckets), buckets).collect()  # a row for each bucket
    gains = np.zeros(buckets, dtype=np.int64)
    gains[[r.bucket for r in found]] = [r.gain for r in found]
    scored = weigh(texts, ["doc_id", "t"], spark.sparkContext.broadcast(gains), buckets)
    scored = scored.withColumn("score", F.col("weight") + noise(seed, F.col("doc_id")))
    scored = durable(scored, "weights")  # slim rows; ranges are sampled before they are dealt, and texts must not be read for that
    long_enough = F.col("n_words") >= least_words
    order = scored.withColumns({"__in": long_enough, "__low": -F.col("score"), "__no_id": F.col("doc_id").isNull()})
    ranked = durable(global_rank(order, ["__low", "__no_id", "doc_id", "t"], ["__in"], "__r"), "scores")
    drawn = ranked.filter("__in").count() * share // 100
    rank = F.when(F.col("__in") & (F.col("__r") < drawn), F.col("__r") + 1)
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def resampling_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")
