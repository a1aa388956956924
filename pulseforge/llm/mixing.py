"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets come from weights by water-filling under a cap. A keyed hash puts each source's documents in a fixed
random order; a source is drawn whole as often as its target asks and once more as far as the rest goes, the
last document cut at a word. The number of draws of each source is then split between output shards down a
binary tree: each node deals its left half a multivariate-hypergeometric share of every source's quota, so
shards have equal sizes and sum exactly to the quotas. A shard's share of a source is a run of consecutive
draws in the permuted order, so shards are disjoint; within a shard rows are ordered by another keyed hash.

The order within a source is found without sorting a source in one task: rows are ranked within
(source, hash range) and the ranges' totals are summed up beside them, so a hot source spreads out.
The table of sources has one row per source and one node of the tree holds one entry per source, so a mix of more than
MOST_SOURCES is refused; group hosts into sources first. Draws are hypergeometric, by the inverse of the CDF, but for quotas of
many millions of documents (see _draw). What a document gives is counted from its draws as the tree deals them to shards.

Defined results
- Null text has size 0; null source is a source of its own, last in order. Sources of size 0 get target 0.
- Documents without words are never drawn. Repeated rows are drawn as rows of their own.
- An empty table gives an empty result. Only id, text and source columns are read.
- Ties of the hash are broken by doc_id, then by the text's digest; rows equal in all may trade places without changing the result.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, keyed_hash, new_path

#: Weights of sources in order, repeating, and the most a target may be of its source's size.
WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 42
#: Standard deviations summed on either side of a draw's mean, the most values summed, and the most sources of a mix.
TAILS, TERMS, MOST_SOURCES = 8, 4096, 4096


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, n_docs -> with target. One row per source in, one out."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(w) for w in weights])
    t = sources.withColumn("weight", F.element_at(kinds, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("ratio", F.col("source_size") * most / F.col("weight"))
    t = t.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    level = F.min_by(F.when(F.col("ratio") >= F.col("level"), F.col("level")), F.when(F.col("ratio") >= F.col("level"), F.col("ratio")))
    t = t.withColumn("level", level.over(everything))
    target = F.least(F.col("source_size") * float(most), F.col("level") * F.col("weight"))
    return t.select("source", "source_size", "n_docs", target.alias("target"))


def _let(value: Column, f) -> Column:
    """f of the value, worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _draw(marked: Column, rest: Column, slots: Column, node: Column, source: Column, seed: int) -> Column:
    """How many of `slots` drawn without replacement from `rest` are among the `marked`: inverse of the hypergeometric CDF.

    The CDF is summed over TAILS standard deviations about the mean, outside of which less than 1e-14 lies. A window of
    more than TERMS values is answered by a rounded normal draw, whose own spread then exceeds TERMS / 16.
    """
    zero = F.lit(0).cast("long")
    u = (keyed_hash(f"{seed}u", node, source) + (keyed_hash(f"{seed}v", node, source) + 0.5) / F.lit(2.0**32)) / F.lit(2.0**32)
    p = marked / F.greatest(rest, F.lit(1))
    spread = F.sqrt(slots * p * (1 - p) * (rest - slots) / F.greatest(rest - 1, F.lit(1)))
    known = F.struct(u.alias("u"), (slots * p).alias("mean"), spread.alias("spread"), F.greatest(slots - (rest - marked), zero).alias("least"), F.least(marked, slots).alias("most"))
    after = lambda w, k: w * (marked - k) * (slots - k) / ((k + 1) * (rest - marked - slots + k + 1).cast("double"))

    def inverse(v: Column) -> Column:
        """v: known, with the window's ends a and b."""
        ks = F.sequence(v["a"], v["b"])
        sums = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("total"))
        total = F.aggregate(ks, sums, lambda s, k: F.struct(after(s["w"], k).alias("w"), (s["total"] + s["w"]).alias("total")), lambda s: s["total"])
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("cdf"), zero.alias("under"), (v["u"] * total).alias("at"))

        def step(s: Column, k: Column) -> Column:
            cdf = s["cdf"] + s["w"]
            return F.struct(after(s["w"], k).alias("w"), cdf.alias("cdf"), (s["under"] + (cdf < s["at"]).cast("long")).alias("under"), s["at"].alias("at"))

        return F.least(v["a"] + F.aggregate(ks, start, step, lambda s: s["under"]), v["b"])

    def normal(v: Column) -> Column:
        u2 = (keyed_hash(f"{seed}w", node, source) + 0.5) / F.lit(2.0**32)
        near = F.round(v["mean"] + v["spread"] * F.sqrt(-2 * F.log(v["u"])) * F.cos(2 * math.pi * u2)).cast("long")
        return F.least(F.greatest(near, v["least"]), v["most"])

    def windowed(v: Column) -> Column:
        a = F.greatest(v["least"], F.floor(v["mean"] - TAILS * v["spread"] - TAILS).cast("long"))
        b = F.least(v["most"], F.ceil(v["mean"] + TAILS * v["spread"] + TAILS).cast("long"))
        return F.struct(*[v[c].alias(c) for c in ("u", "mean", "spread", "least", "most")], a.alias("a"), F.greatest(a, b).alias("b"))

    return _let(_let(known, windowed), lambda v: F.when(v["b"] - v["a"] < TERMS, inverse(v)).otherwise(normal(v)))


def _split(items: Column, node: Column, seed: int) -> Column:
    """array of left quotas for a node's array<struct<source, quota>>, which sum to half of the node."""
    total = F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x["quota"])

    def step(acc: Column, x: Column) -> Column:
        draw = _draw(x["quota"], acc["rest"], acc["slots"], node, x["source"], seed)
        return _let(draw, lambda n: F.struct((acc["rest"] - x["quota"]).alias("rest"), (acc["slots"] - n).alias("slots"), F.array_append(acc["out"], n).alias("out")))

    start = F.struct(total.alias("rest"), F.floor(total / 2).cast("long").alias("slots"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(items, start, step, lambda a: a["out"])


def splitting_tree(quotas: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """source, quota -> source, shard, quota. shards is a power of two."""
    depth = int(math.log2(shards))
    if 2**depth != shards:
        raise ValueError("shards must be a power of two")
    item = F.struct("source", F.col("quota").cast("long").alias("quota"))
    items = quotas.groupBy().agg(F.sort_array(F.collect_list(item)).alias("items"))
    checked = F.when(F.size("items") > MOST_SOURCES, F.raise_error(F.lit(f"more than {MOST_SOURCES} sources"))).otherwise(F.col("items"))
    tree = items.select(F.lit(1).alias("node"), checked.alias("items"))
    for _ in range(depth):
        tree = tree.withColumn("left", _split(F.col("items"), F.col("node"), seed))
        take = lambda side: F.zip_with("items", "left", lambda x, q: F.struct(x["source"].alias("source"), (q if side == 0 else x["quota"] - q).alias("quota")))
        halves = F.array(*[F.struct((F.col("node") * 2 + side).alias("node"), take(side).alias("items")) for side in (0, 1)])
        tree = tree.select(F.explode(halves).alias("h")).select("h.node", "h.items")
    leaves = tree.select((F.col("node") - shards).alias("shard"), F.explode("items").alias("x"))
    return leaves.select("x.source", "shard", "x.quota")


def plan_mix(docs: DataFrame, shards: int = 16, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, ranges: int = 1024) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and draws: array<struct<copy, words, shard>>."""
    return _planned(docs, F.sha2("text", 256), shards, seed, weights, most, ranges).drop("__row")


def _planned(docs: DataFrame, digest: Column, shards: int, seed: int, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, ranges: int = 1024) -> DataFrame:
    """plan_mix with __row, the digest that tells rows of one doc_id apart."""
    h = keyed_hash(seed, F.col("doc_id"))
    slim = docs.select("doc_id", "source", F.unhex(digest).alias("__row"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), h.alias("h"))
    slim = durable(slim.withColumn("range", F.shiftright("h", 32 - int(math.log2(ranges))).cast("int")), "mix_sizes")

    parts = slim.groupBy("source", "range").agg(F.sum("size").alias("words"), F.count(F.when(F.col("size") > 0, 1)).alias("docs"))
    sources = parts.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("docs").alias("n_docs"))
    targets = source_targets(sources, weights, most)
    whole = F.floor(F.col("target") + 0.5).cast("long")
    size = F.greatest("source_size", F.lit(1))
    targets = targets.withColumn("passes", F.floor(whole / size).cast("long")).withColumn("rest", whole - F.col("passes") * F.col("source_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("words", "docs")])
    parts = durable(_join_source(parts, targets, ["source"]), "mix_parts")

    within = Window.partitionBy("source", "range").orderBy("h", "doc_id", "__row")
    placed = _join_source(slim, parts, ["source", "range"])
    placed = placed.withColumn("before", F.col("words_before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rank = F.col("docs_before") + F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).over(within.rowsBetween(Window.unboundedPreceding, 0)) - 1
    placed = placed.withColumn("rank", rank).withColumn("last", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before"))))
    placed = placed.withColumn("n_draws", F.when(F.col("size") > 0, F.col("passes") + (F.col("last") > 0).cast("long")).otherwise(0))
    placed = durable(placed.select("doc_id", "source", "__row", "range", "size", "source_size", "target", "passes", "n_docs", "rank", "last", "n_draws"), "mix_placed")

    dealt = splitting_tree(placed.groupBy("source").agg(F.sum("n_draws").alias("quota")), shards, seed)
    by_shard = Window.partitionBy("source").orderBy("shard")
    ends = dealt.select("source", "shard", F.sum("quota").over(by_shard).alias("end")).groupBy("source").agg(F.sort_array(F.collect_list("end")).alias("ends"))
    ends = durable(_join_source(parts.select("source", "range"), ends, ["source"]), "mix_ends")

    full = _join_source(placed, ends, ["source", "range"])
    copies = F.when(F.col("n_draws") > 0, F.sequence(F.lit(0).cast("long"), F.col("n_draws") - 1)).otherwise(F.array().cast("array<bigint>"))

    def draw(c: Column) -> Column:
        at = c * F.col("n_docs") + F.col("rank")
        words = F.when(c < F.col("passes"), F.col("size")).otherwise(F.col("last"))
        return F.struct(c.alias("copy"), words.alias("words"), F.size(F.filter("ends", lambda e: e <= at)).alias("shard"))

    return full.select("doc_id", "source", "__row", "size", "source_size", "target", F.transform(copies, draw).alias("draws"))


def _join_source(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys of which the source may be null."""
    right = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    on = None
    for k in keys:
        same = left[k].eqNullSafe(right[f"__{k}"]) if k == "source" else left[k] == right[f"__{k}"]
        on = same if on is None else on & same
    return left.join(right, on).drop(*[f"__{k}" for k in keys])


def mix_digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, source_size, target, taken (words of the draws), n_draws, dealt (copy:shard:words of each draw, in order)."""
    words = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    dealt = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d["copy"], d["shard"], d["words"])), ",")
    return plan_mix(docs, shards).select("doc_id", "size", "source_size", "target", words.alias("taken"), F.size("draws").cast("long").alias("n_draws"), dealt.alias("dealt"))


def mixed_rows(docs: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """The mix itself: doc_id, text, lang, source, copy, shard, place, words; one row per draw, cut texts cut at a word.

    Rows are told apart by doc_id, source, language and text; equal rows are drawn each.
    """
    digest = F.sha2(F.concat(F.coalesce("lang", F.lit("")), F.lit("\0"), F.coalesce("text", F.lit(""))), 256)
    draws = _planned(docs, digest, shards, seed).select(F.struct("doc_id", "source", "__row").alias("__drawn"), F.explode("draws").alias("d"))
    draws = draws.select("__drawn", "d.copy", "d.shard", "d.words")
    # structs are never null, and texts placed by one meet their draws without a second shuffle
    texts = docs.select(F.struct("doc_id", "source", F.unhex(digest).alias("__row")).alias("__key"), "doc_id", "text", "lang", "source")
    texts = texts.repartition("__key").dropDuplicates(["__key"])
    rows = draws.join(texts, draws["__drawn"] == texts["__key"])
    words = F.regexp_extract_all("text", F.lit(WORD), 0)
    cut = F.when(F.regexp_count("text", F.lit(WORD)) > F.col("words"), F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), " ")).otherwise(F.col("text"))
    place = keyed_hash(f"{seed}p", F.col("shard"), F.col("doc_id"), F.col("copy"))
    return rows.select("doc_id", cut.alias("text"), "lang", "source", "copy", "shard", place.alias("place"), "words")


def write_mix(docs: DataFrame, path: str | None = None, shards: int = 16, seed: int = SEED) -> str:
    """Write the mix by shard, each shuffled locally; returns the folder."""
    path = path or new_path(docs.sparkSession, "mix")
    _write(mixed_rows(docs, shards, seed), path, shards)
    return path


def written_mix(docs: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """The mix as write_mix leaves it, read back."""
    rows, path = mixed_rows(docs, shards, seed), new_path(docs.sparkSession, "mix")
    _write(rows, path, shards)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def _write(rows: DataFrame, path: str, shards: int) -> None:
    """A shard's rows by place, cut into ranges of places that different tasks write, so a task does not grow with a shard."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards)
    ranges = 4 * -(-n // shards)
    cut = F.floor(F.col("place") * ranges / F.lit(2.0**32))
    dealt = rows.repartition(n, "shard", cut).sortWithinPartitions("shard", "place", "doc_id", "copy", "text", "words")
    dealt.write.partitionBy("shard").parquet(path)
