"""Sample formats, headers and the recording data source."""

import numpy as np
import pytest

from pulseforge.functions import waveforms as w
from pulseforge.operators import signals
from pulseforge.sources import recordings


def decode(head, **files):
    return w.decode(w.read_header(head), {k.replace("_", "."): v for k, v in files.items()})


X = np.array([[5, -7], [300, 2], [-1, 90], [0, 100]])


@pytest.mark.parametrize("kind, raw", [
    ("16", X.astype("<i2").tobytes()),
    ("61", X.astype(">i2").tobytes()),
    ("32", X.astype("<i4").tobytes()),
    ("160", (X + 32768).astype("<u2").tobytes()),
    ("24", b"".join(int(v).to_bytes(3, "little", signed=True) for v in X.ravel())),
    ("212", b"".join(bytes([a & 255, (a >> 8 & 15) | (b >> 8 & 15) << 4, b & 255]) for a, b in X.tolist())),
])
def test_formats(kind, raw):
    got = decode(f"E 2 500\nE.dat {kind} 10\nE.dat {kind} 100(-10)/uV 12 3\n", E_dat=raw)
    assert np.allclose(got, [X[:, 0] / 10, (X[:, 1] + 10) / 100])
    late = decode(f"E 2 500\nE.dat {kind}+5 10\nE.dat {kind}+5 100(-10)/uV 12 3\n", E_dat=b"12345" + raw)
    assert np.array_equal(got, late)


def test_bytes_with_an_offset_and_an_odd_number_of_packed_samples():
    x = decode("E 1\nE.dat 80 1\n", E_dat=bytes([128, 130, 0, 127]))[0]
    assert x[:2].tolist() == [0.0, 2.0] and np.isnan(x[2]) and x[3] == -1.0
    x = decode("E 1 250 3\nE.dat 212 1\n", E_dat=bytes([1, 0x80, 0, 7, 0]))[0]
    assert x[0] == 1.0 and np.isnan(x[1]) and x[2] == 7.0


def test_scales():
    raw = np.array([0, 1024, -32768], dtype="<i2").tobytes()
    for said, want in (("0/mV 16 1024", [-5.12, 0.0]), ("200(24)/mV 16 1024", [-0.12, 5.0]), ("", [0.0, 5.12]), ("1e3", [0.0, 1.024])):
        got = decode(f"﻿# first\n\nE 1 500/2(0) 3 10:00:00\nE.dat 16 {said}\n# Age: 3\n", E_dat=raw)[0]
        assert np.allclose(got[:2], want) and np.isnan(got[2])


def test_frames_of_several_samples_are_averaged():
    raw = np.array([1, 3, 10, 5, 7, 20], dtype="<i2").tobytes()
    assert decode("E 2\nE.dat 16x2 1\nE.dat 16 1\n", E_dat=raw).tolist() == [[2.0, 6.0], [10.0, 20.0]]


@pytest.mark.parametrize("head, why", [
    ("", "first line"),
    ("E/3 2 500\n", "segments"),
    ("E 2 500\nE.dat 16\n", "fewer"),
    ("E 0 500\n", "no leads"),
    ("E 1 500\nE.dat 8 1\n", "format 8"),
    ("E 1 500\nE.dat x 1\n", "cannot be read"),
    ("E 1 500\nE.dat 16:4 1\n", "skewed"),
    ("E 1 500\n../E.dat 16 1\n", "folder"),
    ("E 1 500 9\nE.dat 16 1\n", "shorter"),
    ("E 2 500\nE.dat 16 1\nF.dat 16 1\n", "different lengths"),
    ("E 2 500\nE.dat 16 1\nE.dat 61 1\n", "different formats"),
])
def test_what_cannot_be_read_says_why(head, why):
    with pytest.raises(w.Unreadable, match=why):
        decode(head, E_dat=b"\0\0\0\0", F_dat=b"\0\0")


def test_source_reads_every_header_once(spark, tmp_path):
    for g in range(3):
        d = tmp_path / "set 1+é" / f"g{g}"
        d.mkdir(parents=True)
        for k in range(20):
            (d / f"E{k}.hea").write_text(f"E{k} 1 500\nE{k}.dat 16 {g + 1}/mV\n")
            (d / f"E{k}.dat").write_bytes(np.array([k, 6], dtype="<i2").tobytes())
    (tmp_path / "set 1+é" / "g1" / "E3.dat").unlink()
    (tmp_path / "set 1+é" / "g2" / "E4.hea").write_text("E4 1 500\nE4.dat 310 1\n")
    got = recordings.read_recordings(spark, str(tmp_path), partition_bytes=200)
    assert got.rdd.getNumPartitions() > 5 and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert len(rows) == len({(r.folder, r.exam_id) for r in rows}) == 60 and {r.dataset for r in rows} == {"set 1+é"}
    of = {(r.folder, r.exam_id): r for r in rows}
    assert of["g0", "E7"].tracing == [[7.0, 6.0]] and of["g2", "E7"].tracing[0] == pytest.approx([7 / 3, 2.0])
    assert of["g1", "E3"].reason == "a sample file is missing" and of["g2", "E4"].reason == "format 310 is not read"
    assert sum(r.tracing is None for r in rows) == 2
    marked = signals.mark_rejects(got).filter("why is not null").collect()
    assert [r.why for r in marked] == ["undecodable"] * 2
    assert recordings.read_recordings(spark, str(tmp_path)).rdd.getNumPartitions() == 1
    assert recordings.read_recordings(spark, str(tmp_path / "set 1+é" / "g0"), 1).count() == 20
    (tmp_path / "none").mkdir()
    assert recordings.read_recordings(spark, str(tmp_path / "none")).count() == 0


def test_one_bad_exam_does_not_fail_the_others(spark):
    rows = [("a", "s", [[1.0, 2.0, 3.0], [0.0, 1.0, 5.0]]), ("b", "s", [[1.0, 2.0, 3.0], [1.0]]), ("c", "s", None), ("d", None, [[1.0, float("nan")], [2.0, 2.0]]), ("e", "s", [])]
    df = spark.createDataFrame([(*r, "D1", 400.0 if r[0] != "e" else None) for r in rows], "exam_id string, source string, tracing array<array<float>>, collection string, rate double")
    seen = signals.Observation()
    kept = {r.exam_id for r in signals.normalize_signals(df, seen).collect()}
    assert kept == {"a", "e"}
    assert signals.reject_counts(seen) == {"exams": 5, "undecodable": 0, "missing": 1, "ragged": 1, "nan": 1, "no_rate": 1}
    assert {(r.exam_id, r.why, r.dropped) for r in signals.rejected_records(df).collect()} == {("b", "ragged", True), ("c", "missing", True), ("d", "nan", True), ("e", "no_rate", False)}
    for f in (signals.remove_baseline, signals.z_norm, signals.resample):
        assert "b" not in {r.exam_id for r in f(df).collect()}


def test_small_files_are_dealt_by_their_number_and_the_plan_holds_no_names(spark, tmp_path):
    for k in range(4500):
        d = tmp_path / "set" / f"g{k % 2}"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"E{k}.hea").write_text(f"E{k} 1 500\nE{k}.dat 16 1/mV\n")
        (d / f"E{k}.dat").write_bytes(np.array([k, 6], dtype="<i2").tobytes())
    (tmp_path / "big.bin").write_bytes(bytes(1 << 20))  # lies beside no header
    got = recordings.read_recordings(spark, str(tmp_path), partition_bytes=1 << 22)
    assert got.rdd.getNumPartitions() == 9  # 9,000 files that count 4,096 bytes each
    assert sorted((r.folder, r.exam_id, r.tracing[0][0]) for r in got.collect()) == sorted((f"g{k % 2}", f"E{k}", float(k)) for k in range(4500))
    assert vars(recordings.RecordingReader("none", 3, "none", ".hea").partitions()[2]) == {"number": 2}
    names = recordings._listed(recordings.file_system(str(tmp_path))[0], str(tmp_path / "set" / "g0"))
    assert next(names)[0].startswith("E")  # one after the other
    with pytest.raises(NotADirectoryError):
        recordings.read_recordings(spark, str(tmp_path / "absent"))


def test_headers_are_found_by_tasks_as_sparks_reader_finds_them(spark, tmp_path):
    for name in ("a b+c%é/E 1.hea", "a b+c%é/_x/E2.hea", ".h/E3.hea", "_E4.hea", "_a=E5.hea", "s/g/E6.hea", "s/g/E6.dat", "s/_g=1/E7.hea", "s/E8.head"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("E 1 500\n# Dx: 1\n")
    (tmp_path / "s" / "E9.hea").write_text("")
    for k in range(30):
        (tmp_path / "s" / "g" / f"F{k}.hea").write_bytes(b"F 1 250\n# Dx: \xff\n")
    for root in (str(tmp_path), f"file://{tmp_path}/", f"file:{tmp_path}/s"):
        for pattern in ("*.hea", "{E,F}[0-6]*.h?a"):
            files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(recordings.F.col("_metadata.file_path").alias("path"), "value")
            found = recordings.read_headers(spark, root, pattern, partition_bytes=1)
            assert found.rdd.getNumPartitions() > 5 and "FileScan" not in found._jdf.queryExecution().executedPlan().toString()
            assert sorted(found.collect()) == sorted(recordings.parse_headers(files).collect())
    (tmp_path / "none").mkdir()
    assert recordings.read_headers(spark, str(tmp_path / "none")).count() == 0
