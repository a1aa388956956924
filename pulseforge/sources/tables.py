"""Metadata, weight and configuration files."""

import csv
import io
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.labels import strip
from ..shared import file_system

DROPPED = "nn_predicted_age"


def source_pairs(signals: DataFrame, metas: DataFrame) -> DataFrame:
    """Columns `path` of both -> name, signal_path, meta_path, has_meta: files of one folder whose names differ in the ending alone."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    s = signals.select(stem.alias("__stem"), F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name"), F.col("path").alias("signal_path"))
    m = metas.select(stem.alias("__stem"), F.col("path").alias("meta_path"))
    return s.join(m, "__stem", "left").drop("__stem").withColumn("has_meta", F.col("meta_path").isNotNull())


def metadata_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """path and length of every file below, as a table: no content is read, and tasks get files of about equal bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders).select("path", "length")


def _csv_rows(path: str) -> Iterator[list[str]]:
    """A file's rows that are not blank, the header first; a byte-order mark is passed over. Bytes are read as rows are asked for."""
    where, place = file_system(path)
    with where.open_input_stream(place) as raw:
        for row in csv.reader(io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace", newline="")):
            if any(cell.strip() for cell in row):
                yield row


def _header(rows: Iterator[list[str]]) -> list[str] | None:
    return next(([cell.strip() for cell in row] for row in rows), None)


def headers_of(files: DataFrame) -> DataFrame:
    """files (path) -> path, header: the names in each file's first row that is not blank, of which the first bytes are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_header(_csv_rows(p)) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], ["path", "header"])

    return files.select("path").mapInArrow(run, "path string, header array<string>")


def read_metadata(spark: SparkSession, folders: list[str], classes: list[str], batch_rows: int = 8192) -> DataFrame:
    """Many CSV files as one table of strings, with source_classes: which of `classes` the file's own header has.

    Every file is read by its own header, whatever the others in its folder have; names may have blanks around them, and blank
    lines and byte-order marks are passed over. Columns that a file lacks, and empty cells, are null; files without a row are passed
    over. A task reads whole files. The driver sees one row for each distinct header, however many files have it.
    """
    files = metadata_files(spark, folders)
    headers = sorted(r.header for r in headers_of(files).filter("header is not null").select("header").distinct().collect())
    if not headers:
        raise ValueError("no metadata files")
    names = [c for c in dict.fromkeys(c for h in headers for c in h) if c and c != DROPPED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(of: list[list[str]], at: list[int | None], has: list[str]) -> pa.RecordBatch:
            columns = [pa.array([(row[k] or None) if k is not None and k < len(row) else None for row in of], pa.string()) for k in at]
            return pa.RecordBatch.from_arrays([*columns, pa.array([has] * len(of), pa.list_(pa.string()))], [*names, "source_classes"])

        for b in batches:
            for path in b.column(0).to_pylist():
                rows = _csv_rows(path)
                header = _header(rows) or []
                at, has = [header.index(c) if c in header else None for c in names], [c for c in classes if c in header]
                while of := list(islice(rows, batch_rows)):
                    yield batch(of, at, has)

    schema = StructType([*[StructField(c, StringType()) for c in names], StructField("source_classes", ArrayType(StringType()))])
    return files.select("path").mapInArrow(run, schema)


def split_by_source(df: DataFrame, key: str, path: str) -> None:
    """One CSV folder for each trimmed key; rows with a null key are dropped."""
    df.withColumn(key, strip(F.col(key))).filter(F.col(key).isNotNull()).write.partitionBy(key).csv(path, header=True)


def read_weight_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A square CSV -> class_i, class_j, w. Names of rows and columns must agree; what is not a finite number is NaN. Blanks around
    names and numbers do not count.
    """
    wide = spark.read.csv(path, header=True)
    wide = wide.toDF(*[c.strip() for c in wide.columns])
    wide = wide.select(*[strip(F.col(f"`{c}`")).alias(c) for c in wide.columns])
    first, names = wide.columns[0], wide.columns[1:]
    long = wide.unpivot(first, names, "class_j", "v").withColumnRenamed(first, "class_i")
    if {r[0] for r in wide.select(first).collect()} != set(names):  # a row for each class
        raise ValueError("the rows and columns of the matrix name different classes")
    w = F.expr("try_cast(v as double)")
    return long.select("class_i", "class_j", F.when(w.isNull() | (F.abs(w) == float("inf")), float("nan")).otherwise(w).alias("w"))


def weights_of(long: DataFrame, classes: list[str]) -> list[list[float]]:
    """The matrix in class order; at most classes squared rows are read."""
    got = {(r.class_i, r.class_j): r.w for r in long.collect()}
    return [[got.get((a, b), float("nan")) for b in classes] for a in classes]


def json_map(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """One row with one JSON document of key: value, keys in order. df has a row for each class."""
    entries = F.sort_array(F.collect_list(F.struct(key.alias("key"), value.alias("value"))))
    return df.agg(F.to_json(F.map_from_entries(entries)).alias("value"))


def write_json_map(df: DataFrame, key: Column, value: Column, path: str) -> None:
    json_map(df, key, value).coalesce(1).write.text(path)
