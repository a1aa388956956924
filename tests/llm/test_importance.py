"""Prefix CRCs against zlib, and the whole query against plain Python."""

import hashlib
import math
import random
import re
import string
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from pulseforge.llm import importance as im
from pulseforge.llm.queries import QUERIES

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TEXTS = [None, "", "one", "A,b;C É_é ÀB 1-2", "x" * 70000 + " y " + "Z" * 300 + " q", "甲乙 丙丁 " * 30, " ".join(map(str, range(200)))]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def grams(text):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("piece", [1, 2, 5, 1 << 16])
def test_crcs_from_prefixes(monkeypatch, piece):
    monkeypatch.setattr(im, "PIECE", piece)
    shift = im.Shift()
    for text in TEXTS:
        got = [x for c in im.ngram_crcs(im.words_of(text), shift) for x in c.tolist()]
        assert sorted(got) == sorted(crc32(g.encode()) for g in grams(text))


def test_shift_is_appending_zero_bytes():
    shift = im.Shift()
    sizes = np.array([0, 1, 255, 256, 257, 511, 512, 65536, 100003])
    state = np.full(len(sizes), 0x12345678, dtype=np.uint32)
    # crc(a + b) = shift(crc(a)) xor crc(b)
    a = b"some bytes"
    got = shift(np.full(len(sizes), crc32(a), dtype=np.uint32), sizes)
    assert [int(g) ^ crc32(bytes(n)) for g, n in zip(got, sizes.tolist(), strict=True)] == [crc32(a + bytes(n)) for n in sizes.tolist()]
    assert int(shift(state, sizes)[0]) == 0x12345678


def brute(docs, bench, share=5, least=20, seed=42):
    """doc_id, n_features, weight, score, rank of (doc_id, text) rows."""
    buckets = [[crc32(g.encode()) % 10000 for g in grams(t)] for _, t in docs]
    s, t = Counter(b for bs in buckets for b in bs), Counter(crc32(g.encode()) % 10000 for x in bench for g in grams(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * float(big_s + 10000) / ((s[b] + 1) * float(big_t + 10000)))) for b in range(10000)]
    rows = []
    for (i, text), bs in zip(docs, buckets, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in bs)
        rows.append([i, len(bs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    long = [r for r in rows if r[5] >= least]
    for k, r in enumerate(sorted(long, key=lambda r: (-r[3], r[0] is None, r[0] or 0))[: len(long) * share // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def test_query_against_plain_python(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in QUERIES["op13_importance"](spark, sf).collect()]
    assert sorted(got, key=repr) == sorted(brute(docs, bench), key=repr)
    assert sum(g[4] is not None for g in got) > 0


def test_ties_nulls_and_other_tables(spark):
    random.seed(1)
    docs = [(k, " ".join(random.choices("abcde", k=k))) for k in range(60)] + [(None, "a " * 30), (5, None), (59, "b " * 25), (59, "b " * 25)]
    bench = ["a b c", None, ""]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "id long, body string, score int, rank int")
    b = spark.createDataFrame([(t,) for t in bench], "passage string")
    run = lambda b: [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in im.resample(d, b, 50, id_col="id", text_col="body", target_text="passage").collect()]
    assert sorted(run(b), key=repr) == sorted(brute(docs, bench, 50), key=repr)
    assert sorted(run(b.limit(0)), key=repr) == sorted(brute(docs, [], 50), key=repr)
    assert im.resample(d.limit(0), b, id_col="id", text_col="body", target_text="passage").count() == 0
