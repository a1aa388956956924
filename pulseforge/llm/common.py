"""What the corpus operators share: normal forms of text, keeping rows by key, and the shared folder."""

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import discard, durable, keyed_hash, new_path, scratch, shared_dir

__all__ = ["WORD", "ascii_lower", "discard", "durable", "free_name", "keep_rows", "keyed_hash", "new_path", "scratch", "shared_dir", "table"]

WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the built-in lower(), which then does the same."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def free_name(docs: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def keep_rows(docs: DataFrame, kept: DataFrame, keys: list[str], once_by: list[str] | None = None) -> DataFrame:
    """Rows of docs whose keys are in kept, nulls equal to nulls; kept needs no other columns.

    With once_by, rows that are equal in keys and in once_by come back once. The keys are compared as one struct, which
    is never null, so that the join and the removal of repeats need a single shuffle of docs.
    """
    key = free_name(docs, "__key")
    marked = docs.withColumn(key, F.struct(*keys))
    kept = kept.select(F.struct(*[F.col(k).cast(docs.schema[k].dataType).alias(k) for k in keys]).alias("__kept")).distinct()
    found = marked.join(kept, marked[key] == kept["__kept"], "left_semi")
    if once_by is not None:
        found = found.dropDuplicates([key, *once_by])
    return found.drop(key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
