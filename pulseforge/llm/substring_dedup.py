"""Duplicate substrings by suffix sorting in buckets, with ties resolved by ranks of a cover sample.

A window is a string of WIDTH bytes that starts somewhere in a document; a byte goes if a window over it also starts
earlier. Sorting every suffix would move many times the corpus. Instead:

1. Cover sample. The sample of a window is the leftmost position whose hash of the next GRAM bytes is least among
   those inside the window. Like a difference cover, the sample is sparse (about one position in 35), every window
   holds one, and equal windows hold it at equal offsets, whatever their documents' alignment. (A cover of fixed
   period needs about one position in seven, and a rank for each, which is more than the disk allows.)
2. Sample keys are counted over all documents. A window whose sample occurs once occurs once; the others are the only
   suffixes that need sorting.
3. Suffix buckets. Runs of such windows with one sample travel with their bytes to the bucket of the sample's key.
   A bucket is sorted on its own: first the suffixes at sample positions, which gives their ranks and common
   prefix lengths, and the reversed strings before them; then, one offset at a time, the windows that start so many
   bytes before their sample, each being a short string and a sample's rank. Memory is bounded by a bucket.
4. In each set of equal windows all but the first place go; their bytes are cut from the documents.

Documents are dealt into groups by a hash of doc_id and text. Runs of equal bytes are folded within a group before
anything moves, so that a copied document or passage costs each group one row; windows of a key with more than HOT
runs are also dealt one by one, by their own hash, so what a task holds of one key is at most a row of each group.

A group sends each bucket one row, and there are as many buckets as groups. Groups grow with the square root of the corpus, from
GROUP_BYTES to MOST_GROUP_BYTES, so rows grow in proportion to it (about one for 16 KB) up to 250 GB. From there on they grow
faster, though never beyond one row a key (one for about 35 bytes), unless groups are let grow with the executors' memory.

Defined results
- Null text counts as empty. Texts shorter than WIDTH keep every byte.
- Null doc_id comes before all others. Rows of one doc_id are told apart by a 64-bit hash of their text, which orders them too;
  rows equal in both are one document: equal starts are not earlier.
- An empty table gives an empty result. Only the id and text columns are read.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, GRAM, PIECE, GROUPS_IN_TASK, HOT = 100, 32, 1 << 18, 4, 4096
GROUP_BYTES, MOST_GROUP_BYTES, GROWTH = 1 << 22, 1 << 26, 128
REACH = WIDTH - GRAM + 1  # starts of grams inside a window
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_NONE = -(2**63)
_POWERS = np.full(2 * PIECE + 4 * WIDTH, _BASE, dtype=np.uint64)
_POWERS[0] = 1
_POWERS = np.cumprod(_POWERS, dtype=np.uint64)
RUNS = np.dtype([("key", "<u8"), ("doc", "<i8"), ("t", "<i8"), ("at", "<i4"), ("back", "<u1"), ("n", "<u1")])
CUTS = np.dtype([("doc", "<i8"), ("t", "<i8"), ("start", "<i8"), ("n", "<i8")])
#: kind 0: key counts, 1: keys that repeat, 2: runs with their bytes, 3: cuts.
SCHEMA = "to long, kind int, frm long, a binary, b binary"


def _rows(rows: list[tuple]) -> pa.Table:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    names = ["to", "kind", "frm", "a", "b"]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def pieces(docs: list[tuple[int, int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of about PIECE of documents, and for each start of a window in them: its index, document's number and place."""
    data, index, doc, place, size = [], [], [], [], 0
    for d, (_, _, text) in enumerate(docs):
        for k in range(0, max(len(text) - WIDTH + 1, 0), PIECE):
            part = text[k : k + PIECE + WIDTH - 1]
            n = len(part) - WIDTH + 1
            data.append(part)
            index.append(np.arange(size, size + n))
            doc.append(np.full(n, d, dtype=np.int64))
            place.append(np.arange(k, k + n))
            size += len(part)
            if size >= PIECE:
                yield np.frombuffer(b"".join(data), dtype=np.uint8), *map(np.concatenate, (index, doc, place))
                data, index, doc, place, size = [], [], [], [], 0
    if size:
        yield np.frombuffer(b"".join(data), dtype=np.uint8), *map(np.concatenate, (index, doc, place))


def runs_of(docs: list[tuple[int, int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Maximal runs of windows with one sample, the index of each run's first byte, and the bytes of the piece.

    back: bytes from the first window's start to the sample; n: windows in the run.
    """
    ids, hashes = (np.array([x[k] for x in docs], dtype=np.int64) for k in (0, 1))
    for data, index, doc, place in pieces(docs):
        h = data.astype(np.uint64) + np.uint64(1)
        for k in range(5):  # 2, 4, .., 32 bytes
            h = h[: -(1 << k)] * _POWERS[1 << k] + h[1 << k :]
        h = _mixed(h)
        least = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        for k in range(6):
            least = np.minimum(least[: -(1 << k)], least[1 << k :])
        least = np.minimum(least[: len(least) - (REACH - 64)], least[REACH - 64 :])
        sample = (least[index] & np.uint64((1 << 20) - 1)).astype(np.int64)
        new = np.append(True, (sample[1:] != sample[:-1]) | (index[1:] != index[:-1] + 1))
        first = np.flatnonzero(new)
        out = np.empty(len(first), dtype=RUNS)
        out["key"], out["doc"], out["t"], out["at"] = h[sample[first]], ids[doc[first]], hashes[doc[first]], place[first]
        out["back"], out["n"] = sample[first] - index[first], np.diff(np.append(first, len(index)))
        yield out, index[first], data


def _documents(t: pa.Table) -> list[tuple[int, int, bytes]]:
    return list(zip(*[t.column(c).to_pylist() for c in ("doc", "t", "text")], strict=True))


def count_keys(groups: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        keys = np.concatenate([np.zeros(0, np.uint64), *[r["key"] for r, _, _ in runs_of(_documents(t))]])
        keys, counts = np.unique(keys, return_counts=True)
        return _rows(_dealt(keys, groups, 0, key[0].as_py(), keys, np.minimum(counts, 255).astype(np.uint8)))

    return run


def _dealt(by: np.ndarray, groups: int, kind: int, frm: int, a: np.ndarray, b: np.ndarray) -> list[tuple]:
    to = (_mixed(by) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(to[order]) != 0)) if len(to) else np.zeros(0, np.int64)
    return [(int(to[p[0]]), kind, frm, a[p].tobytes(), b[p].tobytes()) for p in np.split(order, cuts[1:]) if len(p)]


def find_repeats(batches: Iterator[pa.RecordBatch], most: int = HOT) -> Iterator[pa.RecordBatch]:
    """Key counts of whole buckets -> for each group its keys that occur twice or more, and whether they are hot."""
    for _, rows in _by_target(batches):
        keys = np.concatenate([np.frombuffer(r[3], "<u8") for r in rows])
        counts = np.concatenate([np.frombuffer(r[4], np.uint8) for r in rows]).astype(np.int64)
        frm = np.repeat([r[2] for r in rows], [len(r[4]) for r in rows])
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
        total = np.add.reduceat(counts[order], first)
        total = np.repeat(total, np.diff(np.append(first, len(order))))
        some = order[total >= 2]
        hot = (total[total >= 2] > most).astype(np.uint8)
        by = np.argsort(frm[some], kind="stable")
        some, hot = some[by], hot[by]
        cuts = np.flatnonzero(np.diff(frm[some]) != 0) + 1
        out = [(int(frm[p[0]]), 1, 0, keys[p].tobytes(), q.tobytes()) for p, q in zip(np.split(some, cuts), np.split(hot, cuts), strict=True) if len(p)]
        yield from _rows(out).to_batches()


def _by_target(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each target; a partition has the whole of its targets, sorted."""
    at, rows = None, []
    for b in batches:
        for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if rows and r[0] != at:
                yield at, rows
                rows = []
            at = r[0]
            rows.append(r)
    if rows:
        yield at, rows


def send_runs(groups: int):
    def run(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        known = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, "<u8") for x in replies.column("a").to_pylist()]])
        hot = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(x, np.uint8) for x in replies.column("b").to_pylist()]])
        order = np.argsort(known, kind="stable")
        known, hot = known[order], hot[order]
        runs, texts = [], []
        for r, index, data in runs_of(_documents(docs)) if len(known) else ():
            at = np.minimum(np.searchsorted(known, r["key"]), len(known) - 1)
            some = known[at] == r["key"]
            r, index, burning = r[some], index[some], hot[at[some]] > 0
            if burning.any():
                r, index = _singly(r, index, burning)
            sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(data)], dtype=np.uint64)])
            end = index + r["n"] + WIDTH - 1
            of = _mixed((sums[end] - sums[index]) * _POWERS[len(_POWERS) - 1 - index] + r["n"])
            runs.append((r, of))
            texts += [data[s:e].tobytes() for s, e in zip(index, end, strict=True)]
        if not sum(len(r) for r, _ in runs):
            return _rows([])
        r, of = np.concatenate([x[0] for x in runs]), np.concatenate([x[1] for x in runs])
        order = np.lexsort((r["at"], r["t"], r["doc"], of))
        same = np.append(False, of[order][1:] == of[order][:-1])
        firsts = order[np.maximum.accumulate(np.where(~same, np.arange(len(order)), 0))]
        # a hash only says where to look: what differs from the first of its hash is kept
        same[same] = [texts[i] == texts[j] for i, j in zip(order[same].tolist(), firsts[same].tolist(), strict=True)]
        later, kept, firsts = order[same], order[~same], firsts[same]
        cut = np.zeros(len(later), dtype=CUTS)
        cut["doc"], cut["t"], cut["start"], cut["n"] = r["doc"][later], r["t"][later], r["at"][later], r["n"][later]
        # an equal run at the same place, of a repeated row, is not a later one
        cut = cut[(r["doc"][later] != r["doc"][firsts]) | (r["t"][later] != r["t"][firsts]) | (r["at"][later] != r["at"][firsts])]
        out = [(key[0].as_py(), 3, 0, cut.tobytes(), b"")] if len(cut) else []
        by = np.where(np.isin(r["key"][kept], known[hot > 0]), of[kept], r["key"][kept]) if hot.any() else r["key"][kept]
        to = (_mixed(by) % np.uint64(groups)).astype(np.int64)
        o = np.argsort(to, kind="stable")
        for p in np.split(o, np.flatnonzero(np.diff(to[o]) != 0) + 1):
            if len(p):
                out.append((int(to[p[0]]), 2, 0, r[kept[p]].tobytes(), b"".join(texts[i] for i in kept[p])))
        return _rows(out)

    return run


def _singly(r: np.ndarray, index: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs in which turned into runs of one window each."""
    a, i = r[which], index[which]
    of = np.repeat(np.arange(len(a)), a["n"])
    step = np.arange(len(of)) - np.repeat(np.cumsum(a["n"].astype(np.int64)) - a["n"], a["n"])
    b = a[of]
    b["at"] += step
    b["back"] -= step.astype(np.uint8)
    b["n"] = 1
    return np.concatenate([r[~which], b]), np.concatenate([index[~which], i[of] + step])


def _classes(strings: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within their keys, and the length of the prefix shared with the one before (-1: another key)."""
    order = np.lexsort((strings, keys))
    wide = strings.dtype.itemsize
    flat = strings[order].view(np.uint8).reshape(len(order), wide)
    shared = np.full(len(order), -1, dtype=np.int64)
    if len(order) > 1:
        differ = flat[1:] != flat[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
        shared[1:][np.diff(keys[order].astype(np.uint64)) != 0] = -1
    return order, shared


def sort_bucket(r: np.ndarray, text: bytes) -> np.ndarray:
    """CUTS: the windows of a bucket's runs that are equal to one at an earlier place."""
    data = np.frombuffer(text, dtype=np.uint8) + np.uint8(1)  # 0 is left for the end; UTF-8 has no 255
    sizes = r["n"].astype(np.int64) + WIDTH - 1
    offset = np.cumsum(sizes) - sizes
    order = np.lexsort((r["at"] + r["back"], r["t"], r["doc"]))
    r, offset, sizes = r[order], offset[order], sizes[order]
    back, n = r["back"].astype(np.int64), r["n"].astype(np.int64)
    padded = np.pad(data, (REACH, WIDTH))
    sample = offset + back + REACH
    after = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[sample]
    after = np.where(np.arange(WIDTH)[None, :] < (sizes - back)[:, None], after, np.uint8(0))
    ranks, right = _classes(np.ascontiguousarray(after).view(f"S{WIDTH}").ravel(), r["key"])
    before = np.lib.stride_tricks.sliding_window_view(padded, REACH)[sample - REACH][:, ::-1]
    before = np.where(np.arange(REACH)[None, :] < back[:, None], before, np.uint8(0))
    lefts, left = _classes(np.ascontiguousarray(before).view(f"S{REACH}").ravel(), r["key"])
    gone = np.zeros((len(r), REACH + 1), dtype=bool)  # by window number within the run
    for d in range(REACH):
        some = np.flatnonzero((back >= d) & (back - d < n))
        if len(some) < 2:
            continue
        of_right, of_left = np.empty(len(r), np.int64), np.empty(len(r), np.int64)
        of_right[ranks] = np.cumsum(right < WIDTH - d)
        of_left[lefts] = np.cumsum(left < d)
        pair = of_right[some] * (len(r) + 1) + of_left[some]
        o = np.argsort(pair, kind="stable")
        same = np.append(False, np.diff(pair[o]) == 0)
        if same.any():
            first = some[o[np.maximum.accumulate(np.where(~same, np.arange(len(o)), 0))]][same]
            later = some[o[same]]
            other = (r["doc"][first] != r["doc"][later]) | (r["t"][first] != r["t"][later]) | (r["at"][first] + back[first] != r["at"][later] + back[later])
            gone[later[other], (back[later] - d)[other]] = True
    edge = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    out = np.zeros(len(row), dtype=CUTS)
    out["doc"], out["t"], out["start"], out["n"] = r["doc"][row], r["t"][row], r["at"][row] + start, end - start
    return out


def sort_buckets(groups: int):
    group_of = lambda docs, hashes: (_mixed(_mixed(docs.view(np.uint64)) ^ hashes.view(np.uint64)) % np.uint64(groups)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_target(batches):
            out = [(r[0], 3, 0, r[3], b"") for r in rows if r[1] == 3]
            sent = [r for r in rows if r[1] == 2]
            if sent:
                runs = np.concatenate([np.frombuffer(r[3], RUNS) for r in sent])
                cut = sort_bucket(runs, b"".join(r[4] for r in sent))
                to = group_of(np.ascontiguousarray(cut["doc"]), np.ascontiguousarray(cut["t"]))
                o = np.argsort(to, kind="stable")
                out += [(int(to[p[0]]), 3, 0, cut[p].tobytes(), b"") for p in np.split(o, np.flatnonzero(np.diff(to[o]) != 0) + 1) if len(p)]
            yield from _rows(out).to_batches()

    return run, group_of


RESULT = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary"


def cut_documents(key: tuple, docs: pa.Table, cuts: pa.Table) -> pa.Table:
    found = np.concatenate([np.zeros(0, CUTS), *[np.frombuffer(x, CUTS) for x in cuts.column("a").to_pylist()]])
    found = found[np.lexsort((found["t"], found["doc"]))]
    first = np.flatnonzero(np.append(True, (np.diff(found["doc"]) != 0) | (np.diff(found["t"]) != 0))) if len(found) else []
    of = {(int(found["doc"][i]), int(found["t"][i])): x for i, x in zip(first, np.split(found, first[1:]), strict=True)} if len(found) else {}
    out = []
    for d, t, text in _documents(docs):
        mine = of.get((d, t), found[:0])
        if not len(mine):
            out.append((d, len(text), 0, 0, hashlib.sha256(text).hexdigest(), b""))
            continue
        depth = np.zeros(len(text) + 1, dtype=np.int64)
        np.add.at(depth, mine["start"], 1)
        np.add.at(depth, np.minimum(mine["start"] + mine["n"] + WIDTH - 1, len(text)), -1)
        away = np.cumsum(depth[:-1]) > 0
        edge = np.diff(np.concatenate([[0], away, [0]]).astype(np.int8))
        spans = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)
        kept = np.frombuffer(text, dtype=np.uint8)[~away].tobytes()
        out.append((d, len(text), int(away.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans.astype("<i8").tobytes()))
    types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
    return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=[x.split()[0] for x in RESULT.split(", ")])


def group_size(size: int) -> int:
    """Bytes of a group for a corpus of so many."""
    return int(min(max(GROUP_BYTES, GROWTH * size**0.5), MOST_GROUP_BYTES))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (binary: start and end of each removed run as int64)."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = docs.select(F.sum(F.octet_length(raw)).alias("n")).first()["n"] or 0
    groups = max(1, -(-int(size) // (group_bytes or group_size(size))))
    # a few groups fall to each partition, which evens out what hashing deals to it
    parts = max(-(-groups // GROUPS_IN_TASK), min(groups, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    run_buckets, group_of = sort_buckets(groups)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, hashes = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(group_of(docs, hashes)), *b.columns], ["to", "doc", "t", "text"])

    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE))
    rows = docs.select(ids.alias("doc"), F.xxhash64(raw).alias("t"), F.encode(raw, "UTF-8").alias("text")).mapInArrow(group, "to long, doc long, t long, text binary")
    rows = rows.repartition(parts, "to")
    counts = rows.groupBy("to").applyInArrow(count_keys(groups), SCHEMA)
    replies = counts.repartition(parts, "to").sortWithinPartitions("to").mapInArrow(lambda batches: find_repeats(batches, hot), SCHEMA)
    sent = rows.groupBy("to").cogroup(replies.groupBy("to")).applyInArrow(send_runs(groups), SCHEMA)
    cuts = sent.repartition(parts, "to").sortWithinPartitions("to").mapInArrow(run_buckets, SCHEMA)
    out = rows.groupBy("to").cogroup(cuts.groupBy("to")).applyInArrow(cut_documents, RESULT)
    return out.select(F.when(F.col("doc") != _NONE, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def substring_digest(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs).drop("spans")
