"""Fill-in-the-middle against plain slicing, restoring across frames, and what is decompressed."""

import hashlib
import random
import re

import pytest

from pulseforge.llm import fill_middle as fm

TEXTS = ["", "a", "ab cd", "x" * 40, "12, é\n\r\n甲乙丙丁 word" * 9, "<<S", "ends in <P", "a" * 7 + "1" + "b" * 9, " ", "\U0001f600\U0001f600 z"]


@pytest.mark.parametrize("size", [1, 3, 8, 1000])
def test_cuts(size):
    frames = fm.Frames()
    for text in TEXTS:
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        stored = frames.store(text, size)
        assert (stored[0][-1] if text else 0) == len(units)
        for a in range(len(units) + 1):
            for b in range(a, len(units) + 1):
                parts, prefix, middle = frames.split(stored, a, b)
                found = ["".join(frames.stream(p)) for p in parts]
                assert found == ["".join(units[:a]), "".join(units[a:b]), "".join(units[b:])]
                assert (prefix, middle) == (len(found[0]), len(found[1]))


def test_restoring_reads_marks_across_frames():
    frames = fm.Frames()
    parts = {"<P>": "left <", "<S>": "S> right <M", "<M>": ">middle<"}
    for form, order in (("psm", "PSM"), ("spm", "SPM")):
        whole = "".join(f"<{m}>" + parts[f"<{m}>"] for m in order)
        for size in (1, 2, 3, 4, 7, 100):
            output = [frames.write(whole[k : k + size]) for k in range(0, len(whole), size)]
            assert "".join(frames.stream(frames.restore(output, form))) == parts["<P>"] + parts["<M>"] + parts["<S>"]
    with pytest.raises(ValueError):
        frames.restore([frames.write("<P>a<S>b")], "psm")


def test_only_cut_frames_are_read(monkeypatch):
    frames, read = fm.Frames(), []
    stored = frames.store("word " * 5000, 100)
    monkeypatch.setattr(frames, "read", lambda f: read.append(f) or fm.Frames.read(frames, f))
    parts, _, _ = frames.split(stored, 1234, 5678)
    assert len(read) == 2 and set(parts[1][1:-1]) <= set(stored[2])


def plain(doc_id, text):
    """n, form, prefix_chars, middle_chars, output."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_outputs_and_round_trip(spark):
    random.seed(3)
    rows = [(k, "".join(random.choices("ab 1\né甲<P>", k=k * 7))) for k in range(60)] + [(None, "no id here"), (7, None), (7, "again"), (7, "again"), (99, "with <M> inside")]
    rows += [(1000 + k, "long text, " * 3000) for k in range(3)]
    docs = spark.createDataFrame(rows, "id long, body string")
    outputs = fm.fill_in_middle(fm.store_texts(docs, "id", "body", frame=64))
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fm.as_text(outputs, "output").collect()]
    assert sorted(got, key=repr) == sorted(((i, *plain(i, t)) for i, t in rows), key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    back = [(r.doc_id, r.frames) for r in fm.as_text(fm.restore_texts(outputs), "frames").collect()]
    assert sorted(back, key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
