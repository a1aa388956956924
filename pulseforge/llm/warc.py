r"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends in a skippable frame that holds the seek
table (compressed and decompressed size of every frame), so a reader finds any frame from the bundle's tail. An
index maps each record identifier to bundle, frame, the frame's offset in the bundle and the record's offset in the frame.
Archives are read back by stretches of READ_FRAMES frames, which are dealt out to all tasks.
Bundles are written by tasks to the shared folder under a name of the task's own and moved into place, so a
repeated task puts the same bytes under the same name, and only bundles that the index names are read.

Of records with equal payloads of at least 100 bytes, that with the smallest id is a response and others revisit
it: they hold headers alone, among them the full payload's digest and length.

Defined results
- Null html is an empty payload. Smaller payloads are all responses.
- Rows that repeat the smallest id of their payload are all responses. Null ids sort after all others.
- A record's identifier is urn:page:ID, with an empty ID for null. Where a table repeats an ID, its rows are numbered, written
  with their numbers, and every identifier ends in its row's number, so identifiers differ; revisits name the first by number.
- A null or odd url is written percent-encoded; an empty table gives no bundle and an empty result.
"""

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, new_path

#: Fixed values of the seekable format and of WARC.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_BYTES = 100
FRAME_BYTES, BUNDLE_BYTES, LEVEL, READ_FRAMES = 1 << 18, 1 << 25, 3, 16
INDEX = "record_id string, bundle string, frame int, frame_offset long, record_offset long, record_bytes long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def record(name: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record by its identifier; with refers_to a revisit, which holds the headers of the answer alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%')}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[6:6] = [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that starts at the offset."""
    end = data.index(b"\r\n\r\n", at)
    head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
    n = int(head["Content-Length"])
    return head, data[end + 4 : end + 4 + n], end + 4 + n + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", *x) for x in sizes)
    return struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(sizes), 0, SEEKABLE)


def read_seek_table(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, read from the bundle's tail."""
    size = file.size()
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * n)
    sizes, at, out = list(struct.iter_unpack("<II", file.read(8 * n))), 0, []
    for packed, plain in sizes:
        out.append((at, packed, plain))
        at += packed
    return out


def read_record(bundle: str, frame: int, record_offset: int) -> tuple[dict[str, str], bytes]:
    """Random access: one frame is read and decompressed."""
    where, path = fs.FileSystem.from_uri(bundle)
    with where.open_input_file(path) as file:
        at, packed, plain = read_seek_table(file)[frame]
        file.seek(at)
        data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)
    return parse(data, record_offset)[:2]


class _Bundles:
    """Writes one task's records, a frame at a time, to bundles in the folder."""

    def __init__(self, folder: str, frame_bytes: int):
        c = TaskContext.get()
        self.folder, self.frame_bytes, self.part, self.try_ = folder, frame_bytes, c.partitionId(), c.taskAttemptId()
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.pack, self.n, self.file, self.frame, self.entries, self.rows = zstandard.ZstdCompressor(level=LEVEL), 0, None, bytearray(), [], []

    def add(self, name: str, data: bytes) -> None:
        self.entries.append((name, len(self.frame), len(data)))
        self.frame += data
        if len(self.frame) >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if not self.entries:
            return
        if self.file is None:
            self.name = f"bundle-{self.part:06d}-{self.n:04d}.warc.zst"
            self.file, self.at, self.sizes = self.fs.open_output_stream(f"{self.root}/.{self.name}.{self.try_}"), 0, []
        packed = self.pack.compress(bytes(self.frame))
        self.file.write(packed)
        self.rows += [(n, f"{self.folder}/{self.name}", len(self.sizes), self.at, o, size) for n, o, size in self.entries]
        self.sizes.append((len(packed), len(self.frame)))
        self.at += len(packed)
        self.frame, self.entries = bytearray(), []
        if self.at >= BUNDLE_BYTES:
            self.end_bundle()

    def end_bundle(self) -> None:
        self.end_frame()
        if self.file is not None:
            self.file.write(seek_table(self.sizes))
            self.file.close()
            self.fs.move(f"{self.root}/.{self.name}.{self.try_}", f"{self.root}/{self.name}")
            self.file, self.n = None, self.n + 1

    def taken(self) -> pa.RecordBatch:
        names = [x.split()[0] for x in INDEX.split(", ")]
        types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in self.rows], t) for k, t in enumerate(types)], names)
        self.rows = []
        return out


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def write_archives(pages: DataFrame, path: str | None = None, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write a record per page; returns the index of all records, itself a written table."""
    spark = pages.sparkSession
    folder = _uri(path or new_path(spark, "warc"))
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(html, "UTF-8").alias("payload"))
    if rows.groupBy("page_id").count().filter("count > 1").isEmpty():
        rows = rows.withColumn("row", F.lit(None).cast("long"))
    else:
        rows = durable(rows.withColumn("row", F.monotonically_increasing_id()), "warc_numbered")
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload"))
    place = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row")
    firsts = rows.filter(F.col("bytes") >= LEAST_BYTES).select("digest", place.alias("place")).groupBy(F.unhex("digest").alias("known"))
    firsts = durable(firsts.agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").select("known", "first"), "warc_firsts")
    rows = rows.join(firsts, (F.unhex(rows["digest"]) == firsts["known"]) & (rows["bytes"] >= LEAST_BYTES), "left")
    name = lambda page, row: F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.coalesce(F.concat(F.lit(":"), row), F.lit("")))
    refers = F.when(~F.col("first.page_id").eqNullSafe(F.col("page_id")) & F.col("first").isNotNull(), name(F.col("first.page_id"), F.col("first.row")))
    rows = rows.select(name(F.col("page_id"), F.col("row")).alias("name"), "url", "payload", "digest", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Bundles(folder, frame_bytes)
        for b in batches:
            for i in range(b.num_rows):
                name, url, payload, digest, refers = (b.column(k)[i].as_py() for k in range(5))
                out.add(name, record(name, url, payload, digest, refers))
            yield out.taken()
        out.end_bundle()
        yield out.taken()

    return durable(rows.mapInArrow(run, INDEX), "warc_index")


def stretches(index: DataFrame, frames: int = READ_FRAMES) -> DataFrame:
    """bundle, stretch: every so many frames of a bundle, dealt out by range."""
    # a range, as partitioning by the columns of distinct() would be left out and its few rows put in one task
    found = index.select("bundle", F.floor(F.col("frame") / frames).alias("stretch")).distinct()
    return found.repartitionByRange(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bundle", "stretch")


def read_archives(index: DataFrame, frames: int = READ_FRAMES) -> DataFrame:
    """Every record of the bundles that the index names, as READ says; response payloads are hashed anew."""

    def page(name: str) -> int | None:
        digits = name.strip("<>").split(":")[2]
        return int(digits) if digits else None

    def frame_rows(data: bytes) -> Iterator[tuple]:
        here = 0
        while here < len(data):
            head, block, here = parse(data, here)
            kind, digest, n = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["WARC-Payload-Length"])
            if kind == "response":
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                digest, n = hashlib.sha256(payload).hexdigest(), len(payload)
            refers = head.get("WARC-Refers-To")
            yield page(head["WARC-Record-ID"]), n, digest, kind, page(refers) if refers else None, head["WARC-Target-URI"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for uri, stretch in zip(*[c.to_pylist() for c in b.columns], strict=True):
                where, path = fs.FileSystem.from_uri(uri)
                with where.open_input_file(path) as file:
                    for at, packed, plain in read_seek_table(file)[stretch * frames : (stretch + 1) * frames]:
                        file.seek(at)
                        found = list(frame_rows(unpack.decompress(file.read(packed), max_output_size=plain)))
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], names)

    return stretches(index, frames).mapInArrow(run, READ)
