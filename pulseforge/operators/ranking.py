"""Global ranks without a task that sees everything: range partitions, counted, then offset."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import durable


def global_rank(df: DataFrame, order: list[str], within: list[str] | None = None, name: str = "rank") -> DataFrame:
    """df with a rank from 0 by `order`, for each `within` if given. `order` must settle every tie that matters.

    Rows are range-partitioned and sorted once and written; partition and place are kept as numbers, so that
    offsets come from one count for each partition and group, however the rows were dealt.
    """
    within = within or []
    spark, keys = df.sparkSession, [*within, *order]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__place", place)
    dealt = durable(dealt, "ranked").withColumn("__part", F.shiftright("__place", 33)).withColumn("__place", F.col("__place").bitwiseAND((1 << 33) - 1))
    # a group starts anew in each partition: its rows there begin at the group's least place
    counts = dealt.groupBy("__part", *within).agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    before = Window.partitionBy(*[F.col(c) for c in within] or [F.lit(0)]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    counts = counts.select("__part", *[F.col(c).alias(f"__{c}") for c in within], "__first", "__before").withColumnRenamed("__part", "__p")
    on: Column = dealt["__part"] == counts["__p"]
    for c in within:
        on = on & dealt[c].eqNullSafe(counts[f"__{c}"])
    out = dealt.join(counts, on)  # one row for each partition and group: small, and Spark checks its size before it broadcasts
    return out.select(*df.columns, (F.col("__before") + F.col("__place") - F.col("__first")).alias(name))
