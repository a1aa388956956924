"""Byte-level BPE against the tiktoken library, and the tree against a plain search."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as tok
import pytest
import tiktoken

from pulseforge.llm import byte_bpe as bpe
from pulseforge.llm.queries import QUERIES

TEXTS = ["", " ", "don't 'll  12345 x", "x" * 5000, "ab" * 3000, "甲乙丙丁" * 300, "é\u0301\r\n\n \t\U0001f600", "<|endoftext|>", "a \x00 b", "A" * 70 + " " * 300 + "\n"]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Ranks.read(tok.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tok.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_leftmost_least_pair(vocabulary):
    random.seed(5)
    ranks = {bytes([x]): x for x in range(256)} | {w: 256 + k for k, w in enumerate([b"aa", b"ab", b"aab", b"ba", b"aaaa", b"abab", b"bb", b"bba"])}
    for _ in range(3000):
        piece = bytes(random.choices(b"abc", k=random.randint(1, 30)))
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while True:
            found = [(ranks[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in ranks]
            if not found:
                break
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert bpe.merge(piece, ranks, 4) == [ranks[p] for p in parts]


def test_encoder_against_library(vocabulary, library):
    random.seed(9)
    encoder = bpe.Encoder(vocabulary, tok.PATTERN)
    texts = TEXTS + ["".join(random.choices("abcdeéß甲 \n'.,0123ABC", k=random.randint(1, 400))) for _ in range(300)]
    for text in texts:
        assert encoder.encode(text).tolist() == library.encode_ordinary(text)


def test_long_texts_and_pattern_groups(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "LISTED", 10)
    monkeypatch.setattr(bpe, "CACHED", 3)
    encoder = bpe.Encoder(vocabulary, f"({tok.PATTERN})")
    for text in TEXTS:
        assert encoder.encode(text).tolist() == library.encode_ordinary(text)
        assert len(encoder.pieces) <= 3


def test_vocabulary_is_checked():
    with pytest.raises(ValueError):
        bpe.Ranks({b"a": 0})


def test_query_against_library(spark, sf, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op12_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id])
        sha = lambda x: hashlib.sha256(x).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(docs[r.doc_id].encode()))


def test_ids_and_bytes(spark, vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_IDS", 50)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)] + [(None, None)], "id long, body string")
    ranks = bpe.vocabulary(spark, tok.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(docs, ranks, tok.PATTERN, "id", "body")
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert got == {None: []} | {k: library.encode_ordinary(t) for k, t in enumerate(TEXTS)}
    back = {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode(encoded, ranks).collect()}
    assert back == {None: ""} | dict(enumerate(TEXTS))
    assert np.int32 == bpe.Encoder(vocabulary, tok.PATTERN).encode("a b").dtype
