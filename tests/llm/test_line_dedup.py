"""Passages planted in texts of their own, by what is removed, and units of every kind."""

import random

import pytest

from pulseforge.llm import line_dedup


def sentence(rng):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(3, 14))).capitalize() + rng.choice(". . . ? !".split())


def prose(rng, n):
    out = []
    while sum(len(s.split()) for s in out) < n:
        out.append(sentence(rng) + rng.choice([" ", " ", "\n"]))
    return "".join(out)


def test_planted_passages_are_caught_and_clean_texts_left_alone(spark):
    rng = random.Random(21)
    passages = [prose(rng, rng.randrange(52, 120)) for _ in range(25)]
    footer = "All rights reserved."
    docs, planted = [], set()
    for i in range(600):
        words = prose(rng, rng.randrange(40, 300)).split(" ")
        if i >= 100 and i % 3 == 0:
            # anywhere, inside a line and a sentence as well
            at = rng.randrange(len(words))
            words[at:at] = passages[i % 25].split(" ")
            planted.add(i)
        docs.append((i, " ".join(words) + (f"\n{footer}" if rng.random() < 0.3 else "")))
    for k, passage in enumerate(passages):
        docs.append((-k - 1, passage))
    got = {r.doc_id: r for r in line_dedup.line_digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    caught = sum(got[i].n_removed >= 0.5 * len(passages[i % 25]) for i in planted) / len(planted)
    clean = [i for i, _ in docs if i not in planted]
    assert caught >= 0.95 and sum(got[i].n_removed == 0 for i in clean) / len(clean) >= 0.99


@pytest.mark.parametrize("unit", ["sentence", "line", "paragraph"])
def test_units(spark, unit):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen."
    rows = [(1, f"a start\n\n{long}\n\nb end"), (2, f"other\n\n{long.upper()}\n\nmore"), (2, "short"), (None, f"{long}\n\nshort"), (2, "short"), (3, None), (4, "")]
    rows += [(5, "甲" * 20 + "。" + "乙" * 20 + "。\n丙"), (6, "丁。\n" + "甲" * 20 + "。" + "乙" * 20 + "。\n戊")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), unit).collect()
    assert len(got) == len(rows)
    kept = {(r.doc_id, r.text): r.kept_text.split() for r in got}
    assert kept[1, rows[0][1]] == ["a", "start", "b", "end"] and kept[2, rows[1][1]] == ["other", "more"]
    assert kept[None, rows[3][1]] == rows[3][1].split() and kept[2, "short"] == ["short"] and kept[3, ""] == []
    if unit == "sentence":
        assert kept[6, rows[8][1]] == ["丁。", "戊"]
    for r in got:
        assert r.kept_text == "".join(c for i, c in enumerate(r.text) if not any(s.s <= i < s.e for s in r.spans))


def test_short_units_go_within_a_run(spark):
    lines = [f"item {k}" for k in range(30)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["first", *lines[3:28], "last"]))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), "line").collect()}
    assert got[1].spans == [] and got[2].kept_text == "first\nlast"
