"""Normalised signals with their metadata, a folder for each source, written so that a run can be repeated.

Every run writes into folders of its own below the sources' and then a note for each source that it brought. A source is read from the
run that its last note names. So a run that was cut short is not seen, one source can be run again without touching the others,
and readers keep what they began with. clear_normalized removes what no note names any more. One writer at a time.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..shared import remove_path

NOTES = "source string, run string, n long, number long"


def _notes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NOTES).parquet(f"{path}/notes")


def write_run(df: DataFrame, path: str) -> str:
    """Write df (with a column source) as a run that no note names yet; its name. Tasks write whole files, a hot source several."""
    run = uuid.uuid4().hex
    df.withColumn("run", F.lit(run)).hint("rebalance", "source").write.mode("append").partitionBy("source", "run").parquet(f"{path}/data")
    return run


def note_run(spark: SparkSession, path: str, run: str) -> None:
    """Let each source that the run brought be read from it from now on: a row for each source."""
    spark.createDataFrame([], NOTES).write.mode("append").parquet(f"{path}/notes")
    last = _notes(spark, path).agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    found = _stored(spark, path).filter(F.col("run") == run).groupBy("source").agg(F.count("*").alias("n"))
    found.select("source", F.lit(run).alias("run"), "n", F.lit(last + 1).cast("long").alias("number")).write.mode("append").parquet(f"{path}/notes")


def write_normalized(df: DataFrame, path: str) -> None:
    """df's sources replace what path holds of them; its other sources stay as they are."""
    note_run(df.sparkSession, path, write_run(df, path))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """Every run's rows; folders' names are text, whatever they look like."""
    found = spark.read.parquet(f"{path}/data").schema
    schema = StructType([StructField(c.name, StringType()) if c.name in ("source", "run") else c for c in found])
    return spark.read.schema(schema).parquet(f"{path}/data")


def current_runs(spark: SparkSession, path: str) -> DataFrame:
    """source, run, n: what each source is read from."""
    last = F.max_by(F.struct("run", "n"), "number")
    notes = _notes(spark, path).filter("number > 0")  # all of them, but said, it lets Spark prune the folders by what is left
    return notes.groupBy("source").agg(last.alias("x")).select("source", "x.run", "x.n")


def read_normalized(spark: SparkSession, path: str) -> DataFrame:
    """All columns as written, source as text. Folders of other runs are pruned, as runs come from a small table."""
    now = current_runs(spark, path).select(F.col("source").alias("__source"), F.col("run").alias("__run"))
    rows = _stored(spark, path)
    return rows.join(now, (rows["run"] == now["__run"]) & rows["source"].eqNullSafe(now["__source"])).drop("run", "__source", "__run")


def clear_normalized(spark: SparkSession, path: str) -> int:
    """Remove the folders of runs that their source is not read from, cut-short ones too; how many. One short row comes back for each."""
    rows = _stored(spark, path).select("source", "run", F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")).distinct()
    now = current_runs(spark, path)
    old = rows.join(now, (rows["run"] == now["run"]) & rows["source"].eqNullSafe(now["source"]), "left_anti").select("folder").collect()
    for r in old:
        remove_path(spark, r.folder)
    return len(old)
