"""Fill-in-the-middle transformation over seekable compressed frames.

A text is stored once as independent zstandard frames of FRAME code points, with the running counts of units and code points at
each frame's end. A unit is a run of A-Z, a-z or any other single code point, and belongs to the frame that its first code point is in.
To transform a text, only the frames that hold the two cuts are decompressed: prefix, middle and suffix are lists of the
stored frames as they are, with the halves of a cut frame compressed anew. The output is such a list with the marks as frames
of their own, and frames that follow one another are a zstandard stream, so anything reads it in order. Digests and restoring
stream frames; a text is never whole in memory again.

The form is plain if the text is empty or holds a mark itself, or by the third number of the key; else suffix first (spm) by
the fourth number, else prefix first (psm). The numbers come from sha256 of `seed:id`, so reruns agree. Restoring reads the output
alone: it looks for the marks in order, across frames, and gives the three parts, held as frames, in the text's order.

Defined results
- Null text counts as empty; an empty text is plain with n of 0. A null id is keyed by the empty string.
- Repeated rows are each returned, and equal rows get equal outputs. An empty table gives an empty result.
- Very long texts, and units longer than a frame, only mean more frames.
- Only the id and text columns are read, so other columns may have any name.
"""

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, LongType, StringType

from .common import durable

FRAME, LEVEL, SEED, PLAIN_SHARE, SPM_SHARE = 8192, 3, 1, 10, 20
#: Bytes of frames in a batch given back.
BATCH_BYTES = 1 << 24
#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = re.compile("<[PSM]>")
FRAMES = ArrayType(BinaryType())


def unit_starts(text: str) -> np.ndarray:
    """bool for each code point: whether a unit starts there, as if a unit started at the first."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lower = codes | 32
    letter = (codes < 128) & (lower >= 97) & (lower <= 122)
    starts = np.ones(len(codes), dtype=bool)
    starts[1:] = ~(letter[1:] & letter[:-1])
    return starts


class Frames:
    """Compresses and reads frames; one for a task."""

    def __init__(self, level: int = LEVEL):
        self.pack, self.unpack = zstandard.ZstdCompressor(level=level), zstandard.ZstdDecompressor()

    def write(self, text: str) -> bytes:
        return self.pack.compress(text.encode("utf-8", "surrogatepass"))

    def read(self, frame: bytes) -> str:
        return self.unpack.decompress(frame).decode("utf-8", "surrogatepass")

    def store(self, text: str, size: int = FRAME) -> tuple[list[int], list[int], list[bytes]]:
        """Units and code points up to each frame's end, and the frames."""
        units, chars, frames, n = [], [], [], 0
        for k in range(0, len(text), size):
            piece = text[max(k - 1, 0) : k + size]  # with the code point before, which tells whether a unit goes on
            n += int(unit_starts(piece)[1 if k else 0 :].sum())
            units.append(n)
            chars.append(min(k + size, len(text)))
            frames.append(self.write(text[k : k + size]))
        return units, chars, frames

    def cut(self, stored: tuple[list[int], list[int], list[bytes]], at: int) -> tuple[int, int, str]:
        """Where the first `at` units end: frame, code points of it that come before, and the frame's text (if it is cut)."""
        units, chars, frames = stored
        k = int(np.searchsorted(units, at, side="right"))  # the frame in which unit `at`, counted from 0, starts
        if k == len(units):
            return k, 0, ""
        before, text = (units[k - 1] if k else 0), self.read(frames[k])
        starts = unit_starts(text)
        starts[0] = int(starts.sum()) == units[k] - before  # else its first code point goes on with the last frame's unit
        return k, int(np.flatnonzero(starts)[at - before]), text

    def split(self, stored: tuple[list[int], list[int], list[bytes]], first: int, second: int) -> tuple[list[list[bytes]], int, int]:
        """Frames of prefix, middle and suffix, and the code points of prefix and middle. Whole frames are taken as they are."""
        _, chars, frames = stored
        (i, x, left), (j, y, right) = self.cut(stored, first), self.cut(stored, second)
        some = lambda text: [self.write(text)] if text else []
        if i == j:
            parts = [frames[:i] + some(left[:x]), some(left[x:y]), some(right[y:]) + frames[j + 1 :]]
        else:
            parts = [frames[:i] + some(left[:x]), some(left[x:]) + frames[i + 1 : j] + some(right[:y]), some(right[y:]) + frames[j + 1 :]]
        start = lambda k: chars[k - 1] if k else 0
        return parts, start(i) + x, start(j) + y - start(i) - x

    def stream(self, frames: Iterable[bytes]) -> Iterator[str]:
        for f in frames:
            yield self.read(f)

    def sha256(self, frames: Iterable[bytes]) -> str:
        h = hashlib.sha256()
        for f in frames:
            h.update(self.unpack.decompress(f))
        return h.hexdigest()

    def restore(self, output: Iterable[bytes], form: str) -> list[bytes]:
        """Frames of the text, from an output's frames and its form."""
        if form == "plain":
            return list(output)
        marks = [PREFIX, SUFFIX, MIDDLE] if form == "psm" else [SUFFIX, PREFIX, MIDDLE]
        parts: dict[str, list[bytes]] = {m: [] for m in marks}
        now, k, held = "", 0, ""
        for text in self.stream(output):
            text = held + text
            while k < 3 and (at := text.find(marks[k])) >= 0:
                if now and at:
                    parts[now].append(self.write(text[:at]))
                now, text, k = marks[k], text[at + 3 :], k + 1
            held = text[-2:] if k < 3 else ""  # a mark may begin here and end in the next frame
            text = text[: len(text) - len(held)]
            if now and text:
                parts[now].append(self.write(text))
        if held:
            parts[now].append(self.write(held))
        if k < 3:
            raise ValueError("the output lacks a mark")
        return parts[PREFIX] + parts[MIDDLE] + parts[SUFFIX]


def in_batches(rows: Iterable[tuple[int, int, tuple]], b: pa.RecordBatch, keep: int, types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded bytes from (row number, bytes, values): the first `keep` columns of the row, then the values."""
    of, found, size = [], [], 0

    def taken() -> pa.RecordBatch:
        at = pa.array(of, pa.int64())
        columns = [pa.array([v[k] for v in found], t) for k, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in range(keep)], *columns], names)

    for i, n, values in rows:
        of.append(i)
        found.append(values)
        size += n
        if size > BATCH_BYTES:
            yield taken()
            of, found, size = [], [], 0
    if of:
        yield taken()


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame: int = FRAME, level: int = LEVEL) -> DataFrame:
    """doc_id, marked (the text holds a mark), units, chars, frames; written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_frames = Frames(level)
        kinds = [pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
        for b in batches:

            def rows():
                for i, text in enumerate(b.column(1)):
                    text = text.as_py() or ""
                    units, chars, frames = with_frames.store(text, frame)
                    yield i, sum(map(len, frames)), (MARK.search(text) is not None, units, chars, frames)

            yield from in_batches(rows(), b, 1, kinds, ["doc_id", "marked", "units", "chars", "frames"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = rows.select("doc_id").schema.add("marked", "boolean").add("units", ArrayType(LongType())).add("chars", ArrayType(LongType())).add("frames", FRAMES)
    return durable(rows.mapInArrow(run, schema), "text_frames")


def fill_in_middle(stored: DataFrame, seed: int = SEED, plain_share: int = PLAIN_SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """store_texts' rows -> doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output (frames, in order).

    plain_share in a hundred texts stay as they are; spm_share in a hundred of the others put the suffix first.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_frames = Frames()
        p, s, m = map(with_frames.write, (PREFIX, SUFFIX, MIDDLE))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary())]

        def one(key: str, marked: bool, stored: tuple) -> tuple:
            units, _, frames = stored
            n = units[-1] if units else 0
            h = [int(key[8 * k : 8 * k + 8], 16) for k in range(4)]
            if not n or marked or h[2] % 100 >= 100 - plain_share:
                return n, "plain", None, None, frames
            parts, prefix, middle = with_frames.split(stored, *sorted((h[0] % (n + 1), h[1] % (n + 1))))
            if h[3] % 100 < spm_share:
                return n, "spm", prefix, middle, [s, *parts[2], p, *parts[0], m, *parts[1]]
            return n, "psm", prefix, middle, [p, *parts[0], s, *parts[2], m, *parts[1]]

        for b in batches:

            def rows():
                for i in range(b.num_rows):
                    key, marked, *at = (b.column(k)[i].as_py() for k in range(1, 6))
                    found = one(key, marked, tuple(at))
                    yield i, sum(map(len, found[-1])), found

            yield from in_batches(rows(), b, 1, kinds, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = stored.select("doc_id", key.alias("key"), "marked", "units", "chars", "frames")
    schema = stored.select("doc_id").schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", FRAMES)
    return rows.mapInArrow(run, schema)


def _streamed(outputs: DataFrame, carried: list[str], added: dict[str, DataType], f: Callable[[Frames, list[bytes], str], tuple[int, tuple]], frames: str = "output", form: str = "form") -> DataFrame:
    """The carried columns with what f makes of a row's frames and form."""
    kinds = [pa.list_(pa.binary()) if t == FRAMES else pa.string() for t in added.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_frames = Frames()
        for b in batches:
            rows = ((i, *f(with_frames, b.column(len(carried))[i].as_py(), b.column(len(carried) + 1)[i].as_py())) for i in range(b.num_rows))
            yield from in_batches(rows, b, len(carried), kinds, [*carried, *added])

    schema = outputs.select(*carried).schema
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return outputs.select(*carried, F.col(frames).alias("__frames"), F.col(form).alias("__form")).mapInArrow(run, schema)


def restore_texts(outputs: DataFrame) -> DataFrame:
    """doc_id, frames of the original text, from fill_in_middle's output and form alone."""

    def f(frames: Frames, output: list[bytes], form: str) -> tuple[int, tuple]:
        found = frames.restore(output, form)
        return sum(map(len, found)), (found,)

    return _streamed(outputs, ["doc_id"], {"frames": FRAMES}, f)


def as_text(rows: DataFrame, frames: str) -> DataFrame:
    """rows with the column of frames decompressed to a string, for outputs that go on as text."""
    carried = [c for c in rows.columns if c != frames]

    def f(with_frames: Frames, of: list[bytes], form: str) -> tuple[int, tuple]:
        text = "".join(with_frames.stream(of))
        return 4 * len(text), (text,)

    return _streamed(rows.withColumn("__none", F.lit("")), carried, {frames: StringType()}, f, frames, "__none")


def fim_digest(docs: DataFrame) -> DataFrame:
    outputs = fill_in_middle(store_texts(docs))

    def f(frames: Frames, output: list[bytes], form: str) -> tuple[int, tuple]:
        return 128, (frames.sha256(output), frames.sha256(frames.restore(output, form)))

    return _streamed(outputs, ["doc_id", "n", "form", "prefix_chars", "middle_chars"], {"output_sha256": StringType(), "restored_sha256": StringType()}, f)
