"""Offsets and context of many matches in long texts, and how time grows with them."""

import re
import time

from pulseforge.llm import pii


def found(spark, text):
    return pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().found


def test_offsets_over_blocks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(pii, "PIECE", 64)
    monkeypatch.setattr(pii, "STRETCH", 192)
    monkeypatch.setattr(pii, "FEW", 3)
    text = "".join(f"é甲 {'mail' if k % 3 == 0 else '....'} me{k}@ab.org {'-' * (k % 50)} " for k in range(200)) + "card 4111 1111 1111 1111"
    got = found(spark, text)
    mails = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]
    assert [(x.s, x.e) for x in got if x.kind == "email"] == mails
    for x in got:
        near = text[max(x.s - 40, 0) : x.s] + "\n" + text[x.e : x.e + 40]
        assert text[x.s : x.e] == x.m
        assert round(x.score, 2) == round(min(pii.SCORES[x.kind] + (0.3 if re.search(pii.CONTEXT[x.kind], near.lower()) else 0), 1), 2)
    assert {x.kind for x in got} == {"email", "card"}


def test_time_is_near_linear(spark):
    def seconds(n):
        text = " ".join(f"x {k % 90 + 10}" for k in range(n)) + " " + " ".join(f"é{k} me{k}@ab.org" for k in range(n // 10))
        began = time.time()
        assert sum(x.kind == "email" for x in found(spark, text)) == n // 10
        return time.time() - began

    seconds(2000)
    small = min(seconds(20000) for _ in range(2))
    assert seconds(80000) < 12 * max(small, 0.5)
