"""Plans and results that hold at size: arrays stay where they are, sources may be null, files have headers of their own."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulseforge.operators import metrics, signals
from pulseforge.sources import tables


def exams(spark):
    rows = [("a", "s", [[1.0, 2.0, 3.0, 2.0]]), ("b", "s", [[5.0, 1.0]]), ("c", None, [[1.0, 7.0, 3.0]]), ("d", None, [[2.0] * 6])]
    return spark.createDataFrame(rows, "exam_id string, source string, tracing array<array<float>>").withColumn("collection", F.lit("D2")).withColumn("rate", F.lit(400.0))


def test_exams_without_a_source_share_one(spark):
    got = {r.exam_id: r for r in signals.remove_baseline(exams(spark), "double").collect()}
    assert set(got) == set("abcd") and got["c"].source is None
    widths = {r.exam_id: r.source_max_t for r in signals.with_source_width(exams(spark)).collect()}
    assert widths == {"a": 4, "b": 4, "c": 6, "d": 6}
    assert signals.normalize_signals(exams(spark)).count() == 4


def test_arrays_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "exams")
    exams(spark).write.parquet(path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # any table is above the limit
    try:
        for f in (signals.remove_baseline, signals.normalize_signals):
            plan = f(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_more_sources_than_are_broadcast_are_joined(spark, monkeypatch):
    monkeypatch.setattr(signals, "BROADCAST_SOURCES", 1)
    assert {r.exam_id: r.source_max_t for r in signals.with_source_width(exams(spark)).collect()} == {"a": 4, "b": 4, "c": 6, "d": 6}


def test_matrices_and_back():
    rows = [[[1.0, 2.0], [3.0, 4.0]], None, [], [[], []], [[5.0], [6.0], [7.0]]]
    column = pa.array([[[9.0]], *rows, [[8.0]]], pa.list_(pa.list_(pa.float32()))).slice(1, 5)
    found = list(signals.matrices(column))
    assert [x.shape for x in found] == [(2, 2), (0, 0), (0, 0), (2, 0), (3, 1)]
    assert signals.list_column(found).to_pylist() == [[[1.0, 2.0], [3.0, 4.0]], [], [], [[], []], [[5.0], [6.0], [7.0]]]
    ragged = pa.array([[[1.0], [1.0, 2.0]], [[4.0, 5.0]]], pa.list_(pa.list_(pa.float32())))
    bad, good = signals.matrices(ragged)
    assert bad is None and good.tolist() == [[4.0, 5.0]]
    assert signals.list_column([good, None, good]).to_pylist() == [[[4.0, 5.0]], None, [[4.0, 5.0]]]


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    for name, text in {"a b+c.csv": "id, AF ,NSR\n1,x,y\n", "b.csv": "NSR,id,AF\ny2,2,x2\n", "c.csv": "id,NSR\n3,y3\n", "deep/d.csv": "id, AF ,NSR\n4,x4,y4\n", "e.csv": ""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.id: (r.AF, r.NSR, r.source_classes) for r in tables.read_metadata(spark, [str(tmp_path)], ["AF", "NSR"]).collect()}
    both = ["AF", "NSR"]
    assert got == {"1": ("x", "y", both), "2": ("x2", "y2", both), "3": (None, "y3", ["NSR"]), "4": ("x4", "y4", both)}
    with pytest.raises(ValueError):
        tables.read_metadata(spark, [str(tmp_path / "e.csv")], ["AF"])


def test_every_resample_is_of_as_many_draws_as_records(spark):
    n, size = 20, 301
    records = spark.range(size).select(F.col("id").alias("rec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("stats"))
    sums = {r.it: r.sums for r in metrics.exact_sums(records, n, 7, 8).collect()}
    assert set(sums) == set(range(n)) and all(s[0] == size for s in sums.values())
    assert {r.it: r.sums for r in metrics.exact_sums(records.repartition(3), n, 7, 8).collect()} == sums
    plan = metrics.exact_sums(records, n, 7)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(leaf" in plan and "Join" not in plan and "Generate explode" not in plan
    means = np.array([s[1] / size for s in sums.values()])
    assert abs(means.mean() - (size - 1) / 2) < 5 and 2 < means.std() < 9  # about 87 / sqrt(301)
    loose = [r.sums[0] for r in metrics.resample_sums(metrics.poisson_draws(records, n, 7), n).collect()]
    assert len(set(loose)) > 5 and abs(np.mean(loose) - size) < 20


def test_poisson_resamples_are_dealt_to_all_tasks_and_take_no_row_for_a_draw(spark):
    preds = spark.range(0, 4000, 1, 1).select(F.col("id").alias("rec_id"), F.array(F.col("id") % 3 == 0, F.col("id") % 5 == 0).alias("labels"), F.array(F.col("id") % 4 == 0, F.col("id") % 5 == 0).alias("decided"))
    found = metrics.bootstrap_ci(preds, [[1.0, 0.5], [0.5, 1.0]], 0, poisson=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(rec_id" in plan and "md5" not in plan
    with_all = {r.metric: r.mean for r in found.collect()}
    assert with_all["hamming_loss"] == pytest.approx(sum((k % 3 == 0) != (k % 4 == 0) for k in range(4000)) / 8000, abs=0.01)


def test_test_exams_are_made_in_the_tasks_that_hold_their_keys(spark):
    leads = spark.createDataFrame([(k, 40.0 + k, 100.0) for k in range(3)], "lead int, amplitude double, offset double")
    found = signals.synthetic_exams(spark.range(5).select((F.col("id") * 10**11).alias("key")), leads, rates=(128, 50))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [x.split("hashpartitioning(")[1].split("#")[0] for x in plan.split("\n") if "hashpartitioning(" in x] == ["key"]
    got = {r.exam_id: r.tracing for r in found.collect()}
    assert set(got) == {f"SYNTH_Fs{rate}_{k * 10**11}" for k in range(5) for rate in (128, 50)}

    def u(*parts):
        h = (7 + sum(parts)) % 2**31
        for _ in range(3):
            h = (h * 1103515245 + 12345) % 2**31
            h ^= h >> 15
        return (h + 0.5) / 2**31

    for k, rate in ((0, 128), (4 * 10**11, 50)):
        for lead, xs in enumerate(got[f"SYNTH_Fs{rate}_{k}"]):
            at = k * 7919 + rate * 104729 + lead * 1299709
            a, o, f, p = ((2 * u(at, 611953) - 1) * (40 + lead), (2 * u(at, 2 * 611953) - 1) * 100, 0.5 + 2.5 * u(at, 3 * 611953), 2 * np.pi * u(at, 4 * 611953))
            noise = [np.sqrt(-2 * np.log(u(at, t * 15485863, 5 * 32452843))) * np.cos(2 * np.pi * u(at, t * 15485863, 6 * 32452843)) for t in range(2 * rate)]
            want = [a * np.sin(2 * np.pi * f * t / rate + p) + o + noise[t] * 0.1 * abs(a) for t in range(2 * rate)]
            assert len(xs) == 2 * rate and np.allclose(xs, want, rtol=1e-6, atol=1e-5)
    assert signals.synthetic_exams(spark.range(2).withColumnRenamed("id", "key"), leads.limit(0)).count() == 0
