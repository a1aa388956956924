"""Recordings as files: header text, sample files as a data source, and the partitioned outputs."""

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import batched
from math import ceil

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import waveforms
from ..functions.labels import strip
from ..operators.signals import list_column
from ..shared import durable, file_system, new_path, scratch

#: Bytes of headers and samples that a task reads, and of decoded samples in a batch; what opening a file counts as in the former.
PARTITION_BYTES, BATCH_BYTES, FILE_BYTES = 1 << 27, 1 << 25, 1 << 12
#: Most recordings, headers or files listed in a batch.
BATCH_ROWS = 1 << 12


def parse_headers(files: DataFrame) -> DataFrame:
    """path, value (whole text) -> exam_id, dataset, path, freq, age, is_male, codes.

    freq: the first line without # whose third word is a number. Of repeated metadata lines the last counts.
    """
    lines = F.transform(F.split("value", r"\r?\n"), strip)
    t = files.select("path", lines.alias("lines"))
    third = F.transform(F.filter("lines", lambda s: ~F.startswith(s, F.lit("#"))), lambda s: F.get(F.split(s, r"\s+"), 2))
    t = t.select("path", "lines", third.alias("third"))

    def last(prefix: str) -> Column:
        said = F.filter("lines", lambda s: F.startswith(s, F.lit(prefix)))
        return F.when(F.size(said) > 0, strip(F.get(F.split(F.element_at(said, -1), ":"), 1)))

    numeric = F.filter("third", lambda s: s.try_cast("double").isNotNull())
    return t.select(
        F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("exam_id"),
        F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1).alias("dataset"),
        "path",
        F.get(numeric, F.lit(0)).cast("double").alias("freq"),
        last("# Age:").try_cast("double").alias("age"),
        (F.lower(last("# Sex:")) == "male").alias("is_male"),
        F.transform(F.split(last("# Dx:"), ","), strip).alias("codes"),
    )


def _listed(where: fs.FileSystem, folder: str) -> Iterator[tuple[str, int | None]]:
    """Names in a folder with their bytes, of folders none. A local folder's listing is never held; pyarrow holds one of another store."""
    if isinstance(where, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for x in found:
                if x.is_dir():
                    yield x.name, None
                elif x.is_file():
                    yield x.name, x.stat().st_size
    else:
        for x in where.get_file_info(fs.FileSelector(folder)):
            if x.type in (fs.FileType.File, fs.FileType.Directory):
                yield x.base_name, (x.size or 0) if x.type == fs.FileType.File else None


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """folder, name, size of every file under root, a level of folders after the other: tasks list folders and write what they find."""
    where, top = file_system(root)
    if where.get_file_info(top).type != fs.FileType.Directory:
        raise NotADirectoryError(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = file_system(root)
        for b in batches:
            for folder in b.column(0).to_pylist():
                for rows in batched(_listed(where, folder), BATCH_ROWS):
                    names, sizes = zip(*rows, strict=True)
                    columns = [pa.array([folder] * len(rows), pa.string()), pa.array(names, pa.string()), pa.array(sizes, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["folder", "name", "size"])

    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, n, levels = spark.createDataFrame([(top.rstrip("/") or "/",)], "folder string"), 1, []
    while n:
        found = durable(folders.repartition(min(n, most)).mapInArrow(run, "folder string, name string, size long"), "listing")
        levels.append(found.filter("size is not null"))
        folders = found.filter("size is null").select(F.concat(F.regexp_replace("folder", "/+$", ""), F.lit("/"), "name").alias("folder"))
        n = folders.count()
    return reduce(DataFrame.union, levels)


def deal_headers(spark: SparkSession, root: str, header: Column, partition_bytes: int, alone: bool = False) -> tuple[str, int]:
    """A table of the headers (files for which `header` holds) under root, dealt by a hash to stretches of about partition_bytes, of
    headers `alone` or with all files beside them; its path and how many stretches. The driver sees two numbers.
    """
    path = new_path(spark, "headers")
    with scratch(spark):
        files = list_files(spark, root)
        heads = files.filter(header)
        weighed = heads if alone else files.join(heads.select("folder").distinct(), "folder", "left_semi")
        size = weighed.agg(F.sum(F.greatest("size", F.lit(FILE_BYTES)))).first()[0] or 0
        n = max(min(ceil(size / partition_bytes), heads.count()), 1)
        dealt = heads.select("folder", "name", F.pmod(F.xxhash64("folder", "name"), F.lit(n)).alias("stretch"))
        parts = min(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
        dealt.repartition(parts, "stretch").write.partitionBy("stretch").parquet(path)
    return path, n


def _heads(dealt: str, stretch: int) -> Iterator[tuple[str, str]]:
    """Folder and name of a stretch's headers."""
    where, top = file_system(dealt)
    for x in where.get_file_info(fs.FileSelector(f"{top}/stretch={stretch}", allow_not_found=True)):
        if x.base_name.endswith(".parquet"):
            with where.open_input_file(x.path) as f:
                for b in pq.ParquetFile(f).iter_batches(BATCH_ROWS, columns=["folder", "name"]):
                    yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)


def read_headers(spark: SparkSession, root: str, pattern: str = "*.hea", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """parse_headers of the files under root whose names match. As Spark's readers do, it passes over empty files and those that are
    hidden or lie in a hidden folder, and a path is a URI.
    """
    within = F.concat(F.substring("folder", len(file_system(root)[1].rstrip("/")) + 1, 1 << 30), F.lit("/"), "name")
    named = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    header = F.col("name").rlike(f"^(?:{named})$") & (F.col("size") > 0) & ~within.rlike("/(\\.|_(?![^/]*=))")
    dealt, n = deal_headers(spark, root, header, partition_bytes, alone=True)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toUri()
    store = f"{uri.getScheme()}://{uri.getAuthority()}" if uri.getAuthority() else f"{uri.getScheme()}:"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = file_system(root)

        def batch(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.binary())], ["path", "value"])

        for b in batches:
            for stretch in b.column(0).to_pylist():
                rows, size = [], 0
                for folder, name in _heads(dealt, stretch):
                    with where.open_input_stream(f"{folder.rstrip('/')}/{name}") as f:
                        rows.append((store + _quoted(f"{folder.rstrip('/')}/{name}"), f.read()))
                    size += len(rows[-1][1])
                    if size > BATCH_BYTES or len(rows) == BATCH_ROWS:
                        yield batch(rows)
                        rows, size = [], 0
                yield batch(rows)

    files = spark.range(0, n, 1, n).mapInArrow(run, "path string, value binary")
    return parse_headers(files.select("path", F.col("value").cast("string").alias("value")))


def _quoted(path: str) -> str:
    """As java.net.URI quotes a path."""
    return re.sub(r"[\x00-\x20\x7f\"#%<>?\[\\\]^`{|}]", lambda m: f"%{ord(m[0]):02X}", path)


SCHEMA = "exam_id string, dataset string, folder string, rate double, leads array<string>, tracing array<array<float>>, reason string"


@dataclass
class Stretch(InputPartition):
    """The headers of one stretch of a table of them."""

    number: int


class RecordingReader(DataSourceReader):
    """A task reads each of its headers with the sample files that the header names; the plan holds numbers alone."""

    def __init__(self, dealt: str, stretches: int, root: str, ending: str):
        self.dealt, self.stretches, self.root, self.ending = dealt, stretches, root, ending

    def partitions(self) -> list[Stretch]:
        return [Stretch(k) for k in range(self.stretches)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        where, _ = file_system(self.root)
        rows, size = [], 0
        for folder, name in _heads(self.dealt, partition.number):
            rows.append(self._recording(where, folder, name))
            size += rows[-1][-2].nbytes if rows[-1][-2] is not None else 0
            if size > BATCH_BYTES or len(rows) == BATCH_ROWS:
                yield _batch(rows)
                rows, size = [], 0
        yield _batch(rows)

    def _recording(self, where: fs.FileSystem, folder: str, name: str) -> tuple:
        rate = leads = tracing = reason = None
        try:
            with where.open_input_stream(f"{folder}/{name}") as f:
                header = waveforms.read_header(f.read().decode("utf-8", "replace"))
            rate, leads = header.rate, [lead.name for lead in header.leads]
            files = {}
            for file in {lead.file for lead in header.leads}:
                with where.open_input_stream(f"{folder}/{file}") as f:
                    files[file] = f.read()
            tracing = waveforms.decode(header, files)
        except FileNotFoundError:
            reason = "a sample file is missing"
        except waveforms.Unreadable as e:
            reason = str(e)
        parents = folder.rstrip("/").split("/")
        return name[: -len(self.ending)], parents[-2] if len(parents) > 1 else "", parents[-1], rate, leads, tracing, reason


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    exam, dataset, folder, rate, leads, tracing, reason = ([r[k] for r in rows] for k in range(7))
    texts = [pa.array(x, pa.string()) for x in (exam, dataset, folder)]
    columns = [*texts, pa.array(rate, pa.float64()), pa.array(leads, pa.list_(pa.string())), list_column(tracing), pa.array(reason, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["exam_id", "dataset", "folder", "rate", "leads", "tracing", "reason"])


class Recordings(DataSource):
    """Header and sample files under a folder as exams; options: path, ending (of header files), dealt and stretches (of deal_headers)."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(self.options["dealt"], int(self.options["stretches"]), self.options["path"], self.options["ending"])


def read_recordings(spark: SparkSession, root: str, partition_bytes: int = PARTITION_BYTES, ending: str = ".hea") -> DataFrame:
    """Every header under root with the samples it names: exam_id (the header's name), dataset and folder it lies in, rate, leads,
    tracing in physical units by lead, reason. What cannot be decoded has no tracing but a reason.

    Formats 16, 24, 32, 61, 80, 160 and 212, at a byte offset or not, in one file or several. A gain of 0 or none is 200, a
    baseline that is not given is the ADC's zero, and the format's missing value is NaN. Equal names in two folders are two exams.
    """
    spark.dataSource.register(Recordings)
    dealt, n = deal_headers(spark, root, F.endswith("name", F.lit(ending)), partition_bytes)
    return spark.read.format("recordings").options(dealt=dealt, stretches=n, ending=ending).load(root)


def write_files(rows: DataFrame, root: str) -> int:
    """Write rows (path under root, content binary) as a file each; how many. A repeated task writes the same bytes over again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = file_system(root)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                where.create_dir(f"{top}/{path}".rsplit("/", 1)[0], recursive=True)
                with where.open_output_stream(f"{top}/{path}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return rows.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
