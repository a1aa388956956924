"""Joins of metadata to signals, patient splits, length buckets, shards and batches. Slim rows only: no arrays move."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import durable, keyed_hash
from .ranking import global_rank

STALE = ("trace_file", "h5_path_src", "h5_idx_src")


def build_inventory(meta: DataFrame, index: DataFrame) -> DataFrame:
    """Inner join on exam_id; what the metadata still says of an older index is dropped; duplicates multiply."""
    return meta.drop(*STALE).join(index, "exam_id")


def align_metadata(signals: DataFrame, meta: DataFrame) -> DataFrame:
    """Each signal with its metadata, or nulls. An exam_id that the metadata has twice raises when the rows are read."""
    once = meta.groupBy("exam_id").agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in meta.columns if c != "exam_id"])
    checked = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("exam_id is not unique in the metadata: "), F.col("exam_id").cast("string")))).otherwise(F.col("exam_id"))
    once = once.withColumn("exam_id", checked).drop("__n")
    return signals.join(once, "exam_id", "left")


def keep_matching(meta: DataFrame, ids: DataFrame) -> DataFrame:
    return meta.join(ids.select("exam_id"), "exam_id", "left_semi")


def patient_split(inv: DataFrame, train: float = 0.8, val: float = 0.1, seed: int = 42, by_collection: bool = False) -> DataFrame:
    """inv with split. Patients in keyed-hash order: int(U*train) train, int(U*val) val, the rest test, null too."""
    keys = ["collection", "patient_id"] if by_collection else ["patient_id"]
    who = inv.filter(F.col("patient_id").isNotNull()).select(*keys).distinct()
    ranked = durable(global_rank(who.withColumn("__h", keyed_hash(seed, *[F.col(k) for k in keys])), ["__h", *keys], name="__r"), "patients")
    u = ranked.count()
    first, second = int(u * train), int(u * train) + int(u * val)
    split = F.when(F.col("__r") < first, "train").when(F.col("__r") < second, "val").otherwise("test")
    return inv.join(ranked.select(*keys, split.alias("split")), keys, "left").withColumn("split", F.coalesce("split", F.lit("test")))


def assign_patient_ids(headers: DataFrame) -> DataFrame:
    """headers with patient_id from 1 in order of dataset and path."""
    return global_rank(headers, ["dataset", "path"], name="__r").withColumn("patient_id", F.col("__r") + 1).drop("__r")


def length_buckets(inv: DataFrame, block: int = 1024, seed: int = 42) -> DataFrame:
    """inv with block and pos (from 0 in each split): sorted by length, cut into blocks, the blocks in keyed-hash order."""
    ranked = global_rank(inv, ["length", "exam_id"], ["split"], "__r").withColumn("block", F.floor(F.col("__r") / block).cast("long"))
    sizes = ranked.groupBy("split", "block").agg(F.count("*").alias("__n"))
    order = Window.partitionBy("split").orderBy(keyed_hash(seed, F.col("split"), F.col("block")), "block")
    sizes = sizes.select("split", "block", (F.sum("__n").over(order) - F.col("__n")).alias("__start"))
    placed = ranked.join(sizes, ["split", "block"])
    return placed.withColumn("pos", (F.col("__start") + F.col("__r") % block).cast("long")).drop("__r", "__start")


def assign_shards(inv: DataFrame, shard_size: int = 8192) -> DataFrame:
    """inv with shard_id: near-equal shards of a split by pos, the first rows % n of them one row larger."""
    counts = inv.groupBy("split").agg(F.count("*").alias("__rows"))
    x = inv.join(counts, "split").withColumn("__n", F.ceil(F.col("__rows") / shard_size))
    x = x.withColumn("__size", F.floor(F.col("__rows") / F.col("__n"))).withColumn("__more", F.col("__rows") % F.col("__n"))
    edge = F.col("__more") * (F.col("__size") + 1)
    shard = F.when(F.col("pos") < edge, F.floor(F.col("pos") / (F.col("__size") + 1))).otherwise(F.col("__more") + F.floor((F.col("pos") - edge) / F.col("__size")))
    return x.withColumn("shard_id", shard.cast("long")).drop("__rows", "__n", "__size", "__more")


def shard_stats(inv: DataFrame) -> DataFrame:
    return inv.groupBy("split", "shard_id").agg(F.count("*").alias("n_rows"), F.max("length").alias("max_length"))


def batch_rows(inv: DataFrame, batch: int = 64, mega: int = 1024, train: bool = True, seed: int = 42) -> DataFrame:
    """inv with mega, batch and place (from 0 in the batch). Rows of a shard are numbered by pos; each block of `mega` is sorted by
    length, blurred by up to a fifth in training, and cut into batches.
    """
    starts = Window.partitionBy("split", "shard_id").orderBy("pos")
    x = inv.withColumn("mega", F.floor((F.row_number().over(starts) - 1) / mega).cast("long"))
    noise = (keyed_hash(seed, F.col("exam_id")) / F.lit(2.0**32) - 0.5) * 0.4
    key = F.col("length") * (1 + noise) if train else F.col("length").cast("double")
    by = Window.partitionBy("split", "shard_id", "mega").orderBy(key, "exam_id")
    x = x.withColumn("place", F.row_number().over(by) - 1)
    return x.withColumns({"batch": F.floor(F.col("place") / batch).cast("long"), "place": (F.col("place") % batch).cast("int")})


BATCH = ("split", "shard_id", "mega", "batch")


def batch_plan(inv: DataFrame, batch: int = 64, mega: int = 1024, train: bool = True, seed: int = 42, least: int = 50, fixed_width: int | None = None) -> DataFrame:
    """split, shard_id, mega, batch, n_rows, width of batch_rows' batches; those of one row, or with no length of `least`, are lost."""
    out = batch_rows(inv, batch, mega, train, seed).groupBy(*BATCH).agg(F.count("*").alias("n_rows"), F.max("length").cast("long").alias("width"))
    out = out.filter((F.col("n_rows") > 1) & (F.col("width") >= least))
    return out.withColumn("width", F.lit(fixed_width).cast("long")) if fixed_width else out


def planned_rows(inv: DataFrame, batch: int = 64, mega: int = 1024, train: bool = True, seed: int = 42, least: int = 50, fixed_width: int | None = None) -> DataFrame:
    """batch_rows' rows of the batches that batch_plan keeps, with n_rows and width of the batch."""
    whole = Window.partitionBy(*BATCH)
    x = batch_rows(inv, batch, mega, train, seed).withColumns({"n_rows": F.count("*").over(whole), "width": F.max("length").over(whole).cast("long")})
    x = x.filter((F.col("n_rows") > 1) & (F.col("width") >= least))
    return x.withColumn("width", F.lit(fixed_width).cast("long")) if fixed_width else x


def sample_per_source(df: DataFrame, n: int, seed: int = 42, key: str = "exam_id") -> DataFrame:
    """min(n, available) rows of each source by keyed hash, numbered in key order. Ranks are limited before the shuffle."""
    by = Window.partitionBy("source").orderBy(keyed_hash(seed, F.col(key)), key)
    some = df.withColumn("__k", F.row_number().over(by)).filter(F.col("__k") <= n).drop("__k")
    return some.withColumn("sample_pos", F.row_number().over(Window.partitionBy("source").orderBy(key)))
