"""Duplicate lines or paragraphs, removed but for their earliest occurrence.

A text is cut into units: lines, cut further at sentence ends ("sentence", as stored prose breaks its lines anywhere), lines
alone ("line"), or paragraphs. A unit's normal form is lower-cased with runs of ASCII whitespace made one space; blank units
are passed over. What is compared is a run of units: each unit with as many of the next ones as it takes to reach LEAST bytes
of normal form. So short units take part in the runs around them, whatever their language, a lone short heading is not taken for
a copy, and a passage is found wherever its first whole unit stands. Digests of runs are grouped globally with partial
minima, only digests that occur twice or more are joined back, and the units of a run go unless it is the earliest by
(doc_id, text hash, start). Removed spans keep their offsets in the original text.

Defined results
- Null text counts as empty. Units include their line break, so what is kept is the text without the removed spans.
- A text's last units of under LEAST bytes together start no run; they go if they end a run that goes.
- Null doc_id sorts first. Rows of one doc_id are told apart by a 64-bit hash of their text; equal rows are one document.
- An empty table gives an empty result. Only the id and text columns are read.
"""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: What ends a unit of each kind.
ENDS = {"sentence": r"[\n。！？]|[.!?](?=[\x20\x09-\x0D])", "line": r"\n", "paragraph": r"\n\n+"}
LEAST = 100
#: Runs in a batch that a task gives.
AT_ONCE = 1 << 15
RUNS = "doc_id long, t long, s int, e int, digest binary"


def runs_of(text: str, ends: re.Pattern, least: int = LEAST) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of every run of units, offsets in code points."""
    units, at = [], 0
    for stop in [*(m.end() for m in ends.finditer(text)), len(text)]:
        if plain := b" ".join(text[at:stop].lower().encode("utf-8", "surrogatepass").split()):
            units.append((at, stop, plain))
        at = stop
    last, size = 0, 0
    for k, (start, _, plain) in enumerate(units):
        while last < len(units) and size < least:
            size += len(units[last][2])
            last += 1
        if size < least:
            return
        yield start, units[last - 1][1], hashlib.md5(b"\n".join(u[2] for u in units[k:last]), usedforsecurity=False).digest()
        size -= len(plain)


def unit_runs(docs: DataFrame, unit: str = "sentence", least: int = LEAST) -> DataFrame:
    """docs (doc_id, t, text) -> doc_id, t, s, e, digest (16 bytes) of every run."""
    pattern = ENDS[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, names = re.compile(pattern), [x.split()[0] for x in RUNS.split(", ")]

        def taken(b: pa.RecordBatch, of: list[int], found: list[tuple]) -> pa.RecordBatch:
            place = pa.array(of, pa.int64())
            columns = [pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]
            return pa.RecordBatch.from_arrays([b.column(0).take(place), b.column(1).take(place), *columns], names)

        for b in batches:
            of, found = [], []
            for i, text in enumerate(b.column(2)):
                for r in runs_of(text.as_py(), ends, least):
                    of.append(i)
                    found.append(r)
                    if len(found) >= AT_ONCE:
                        yield taken(b, of, found)
                        of, found = [], []
            yield taken(b, of, found)

    return docs.mapInArrow(run, RUNS)


def _base(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def repeated_spans(base: DataFrame, unit: str = "sentence", least: int = LEAST) -> DataFrame:
    """doc_id, t, spans: array<struct<s, e>> of the runs to remove, in order, those that overlap or touch not yet joined."""
    rows = durable(unit_runs(base, unit, least), "unit_runs")
    place = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), "t", "s")
    firsts = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").select("digest", "first")
    firsts = durable(firsts, "unit_firsts")
    gone = rows.withColumn("place", place).join(firsts, "digest").filter("place > first")
    return gone.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans"))


def dedup_lines(docs: DataFrame, unit: str = "sentence", least: int = LEAST) -> DataFrame:
    """doc_id, text (the original), kept_text, spans: array<struct<s, e>> of the removed parts, apart from each other."""
    base = _base(docs)
    spans = repeated_spans(base, unit, least).select(F.struct("doc_id", "t").alias("__of"), "spans")
    base = base.withColumn("__key", F.struct("doc_id", "t"))
    base = base.join(spans, base["__key"] == spans["__of"], "left")
    none = F.array().cast("array<struct<s:int,e:int>>")

    def joined(a, x):
        """Spans as (s, e) with the open one in a.last."""
        more = x["s"] <= a["last"]["e"]
        grown = F.struct(a["last"]["s"].alias("s"), F.greatest(a["last"]["e"], x["e"]).alias("e"))
        return F.struct(F.when(more, a["o"]).otherwise(F.array_append(a["o"], a["last"])).alias("o"), F.when(more, grown).otherwise(x).alias("last"))

    rest = F.slice("spans", F.lit(2), F.size("spans"))
    whole = F.aggregate(rest, F.struct(none.alias("o"), F.element_at("spans", 1).alias("last")), joined, lambda a: F.array_append(a["o"], a["last"]))
    base = base.select("doc_id", "text", F.when(F.size("spans") > 0, whole).otherwise(none).alias("spans"))
    step = lambda a, x: F.struct(x["e"].alias("at"), F.array_append(a["o"], F.substring("text", a["at"] + 1, x["s"] - a["at"])).alias("o"))
    end = lambda a: F.array_join(F.array_append(a["o"], F.substring("text", a["at"] + 1, F.length("text") - a["at"])), "")
    kept = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("o")), step, end)
    return base.select("doc_id", "text", F.when(F.size("spans") == 0, F.col("text")).otherwise(kept).alias("kept_text"), "spans")


def line_digest(docs: DataFrame) -> DataFrame:
    spans = F.col("spans")
    place = lambda x: F.concat_ws(":", x["s"], x["e"])
    return dedup_lines(docs).select(
        "doc_id",
        F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"]).alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"),
        F.array_join(F.transform(spans, place), ",").alias("removed"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
        F.length("text").cast("long").alias("text_length"),
    )
