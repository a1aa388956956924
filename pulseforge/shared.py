"""The folder that driver and executors share, tables written there, and keyed hashes."""

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: str | None = None
#: Folders that new_path has named and discard or scratch has not removed.
_named: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own if driver and executors are one process."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="spark-pulseforge-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return _own_folder


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI as Spark writes it, and the path in it. For tasks, which have no session."""
    uri = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(//[^/]*)?(/.*)?$", path)
    if uri is None or uri[1] == "file":
        return fs.LocalFileSystem(), path if uri is None else uri[3]
    return fs.FileSystem.from_uri(f"{uri[1]}:{uri[2] or ''}{quote(uri[3] or '')}")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _named.append(path)
    return path


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder and what it holds."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    if path in _named:
        _named.remove(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that durable wrote and nothing lazy reads any more."""
    for t in tables:
        remove_path(t.sparkSession, t._written_to)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Remove what was written inside the block when it ends, but for the tables put in the list."""
    before, kept = len(_named), []
    yield kept
    for path in set(_named[before:]) - {t._written_to for t in kept}:
        remove_path(spark, path)


def keyed_hash(seed: int | str, *cols: Column) -> Column:
    """32 bits of md5 over seed and columns, as long: the same under any partitioning and in any engine."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 8), 16, 10).cast("long")
