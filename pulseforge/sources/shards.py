"""Shards with their signals: a bucketed signal store, a plan bucketed alike, and the split and shard folders.

Splits, buckets and shards are worked out on slim rows. Signals are stored once, bucketed by exam; a plan is bucketed the same
way, so plan and signals meet bucket by bucket without a shuffle, the slim plan being the side that is hashed. Only the part
of a signal that a shard needs then moves, once, to the task that writes the shard, and is padded there.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import durable, new_path

KEY = "exam_id"


def bucketed(df: DataFrame, path: str, buckets: int) -> DataFrame:
    """df written under path as a table of so many buckets by exam_id, a file for each, and read as such."""
    name = "bucketed_" + uuid.uuid4().hex
    df.repartition(buckets, KEY).write.bucketBy(buckets, KEY).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """What another session wrote with bucketed()."""
    name, schema = "bucketed_" + uuid.uuid4().hex, spark.read.parquet(path).schema
    columns = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def store_signals(df: DataFrame, path: str, buckets: int) -> DataFrame:
    """exam_id and tracing of df, bucketed; the signals move to their buckets here, whatever plans are made of them later."""
    return bucketed(df.select(KEY, "tracing"), path, buckets)


def shard_rows(plan: DataFrame, signals: DataFrame, buckets: int) -> DataFrame:
    """plan (exam_id, split, shard_id, pos, length, start_offset, and whatever else a row is traced back by) with width, the longest
    of the shard, and tracing, the active part padded to it. `signals` is what store_signals gave, of as many buckets.
    """
    spark, plan = plan.sparkSession, durable(plan, "shard_inventory")
    widths = plan.groupBy("split", "shard_id").agg(F.max("length").alias("width"))
    slim = bucketed(plan.join(widths, ["split", "shard_id"]), new_path(spark, "shard_plan"), buckets)
    met = signals.join(slim.hint("shuffle_hash"), KEY)
    part = F.transform("tracing", lambda lead: F.slice(lead, F.col("start_offset") + 1, F.col("length")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.withColumn("tracing", part).repartition(n, "split", "shard_id").sortWithinPartitions("split", "shard_id", "pos")
    zeros = lambda lead: F.array_repeat(F.lit(0.0).cast("float"), F.col("width") - F.size(lead))
    return dealt.withColumn("tracing", F.transform("tracing", lambda lead: F.concat(lead, zeros(lead))))


def write_shards(plan: DataFrame, signals: DataFrame, buckets: int, path: str) -> None:
    """split and shard_id folders with padded signals and the plan's columns, in pos order; a shard is written by one task."""
    shard_rows(plan, signals, buckets).write.partitionBy("split", "shard_id").parquet(path)
