"""Batches that a model is given, and the threshold search on folded records."""

import numpy as np
import pytest
from compare import duck, rows_of
from pyspark.sql import functions as F

from pulseforge.operators import inventory as inv
from pulseforge.operators import scoring
from pulseforge.plans.oracles import ORACLES
from pulseforge.plans.queries import QUERIES


def exams(spark, n=150):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(n):
        size = int(rng.integers(55, 90))
        rows.append((k, k, "train", k % 3, k // 3, size - 4, 2, [k % 2 == 0, False], [rng.random(size).tolist() for _ in range(2)]))
    return spark.createDataFrame(rows, "exam_id long, patient_id long, split string, shard_id long, pos long, length int, start_offset int, labels array<boolean>, tracing array<array<float>>")


def test_a_model_is_called_once_a_batch_with_its_width(spark):
    df = exams(spark)
    plan = inv.planned_rows(df.drop("tracing"), 8, 32, train=True)
    want = {tuple(r) for r in inv.batch_plan(df, 8, 32, True).select("split", "shard_id", "mega", "batch", "n_rows", "width").collect()}

    def load():
        calls = [0]

        def model(x, mask):
            calls[0] += 1
            assert x.shape[0] == mask.shape[0] and x.shape[2] == mask.shape[1] and (x[:, 0][mask == 0] == 0).all()
            return np.stack([np.full(len(x), float(calls[0])), np.full(len(x), float(len(x)))], axis=1)

        return model

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)  # a batch comes in pieces
    try:
        got = scoring.score_batches(plan, df.select("exam_id", "tracing"), load).join(plan.select(F.col("exam_id").alias("rec_id"), *inv.BATCH), "rec_id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    logit = lambda p: round(float(np.log(p / (1 - p))))
    assert {(r.split, r.shard_id, r.mega, r.batch, logit(r.probs[1]), r.width) for r in got} == want
    assert sum(w[4] for w in want) == len(got)
    assert all(len({r.probs[0] for r in got if (r.shard_id, r.mega, r.batch) == w[1:4]}) == 1 for w in want)


def test_exams_without_samples_are_skipped(spark):
    df = exams(spark, 40)
    t = F.when(F.col("exam_id") == 3, F.lit(None)).when(F.col("exam_id") == 4, F.array().cast("array<array<float>>")).when(F.col("exam_id") == 5, F.array(F.array(), F.array()).cast("array<array<float>>"))
    t = t.when(F.col("exam_id") == 6, F.transform("tracing", lambda x, i: F.slice(x, 1, F.lit(60) - i))).otherwise(F.col("tracing"))
    plan = inv.planned_rows(df.drop("tracing"), 8, 32, train=False)
    load = lambda: lambda x, mask: np.stack([x[:, 0].sum(axis=1), np.where(mask.sum(axis=1) > 60, np.inf, 0)], axis=1)
    got = {r.rec_id: r for r in scoring.score_batches(plan, df.withColumn("tracing", t).select("exam_id", "tracing"), load).collect()}
    assert not {3, 4, 5, 6} & set(got)
    of = {r.exam_id: r for r in df.collect()}
    for k, r in got.items():
        part = np.float32(of[k].tracing)[0, 2 : 2 + of[k].length]
        assert r.probs[0] == pytest.approx(1 / (1 + np.exp(-float(part.sum()))), abs=1e-6)
        assert r.finite == (of[k].length <= 60) and r.labels == of[k].labels


def test_the_querys_probabilities_are_those_of_doubles(spark):
    df, sf = QUERIES["U1_score_batches"](spark, "/root/testdata/sf0.01"), "/root/testdata/sf0.01"
    columns = sorted(df.columns)
    assert rows_of(df, columns) == duck(ORACLES["U1_score_batches"], sf, columns)  # all six digits


def test_folded_records_give_the_same_thresholds(spark):
    rng = np.random.default_rng(3)
    y, p = rng.random((400, 3)) < 0.3, np.round(rng.random((400, 3)), 3)
    p[0, 0], p[1, 1], p[2, 2] = np.nan, 0.5, scoring.CANDIDATES[-1]
    once = [(i, [bool(v) for v in y[i]], [float(v) for v in p[i]]) for i in range(400)]
    w = (np.eye(3) * 0.5 + 0.4).tolist()
    df = spark.createDataFrame(once, "rec_id long, labels array<boolean>, probs array<double>")
    bounds = sorted({*scoring.CANDIDATES, 0.5})
    folded = scoring.fold_predictions(df.union(df).union(df), w, 0, bounds)
    assert {r.n % 3 for r in folded.collect()} == {0} and folded.count() <= 400
    a, b = scoring.tune_thresholds(df, w, 0), scoring.tune_thresholds(df.union(df).union(df).repartition(7), w, 0)
    assert {m: t for m, (_, t) in a.items()} == {m: t for m, (_, t) in b.items()}
    assert all(a[m][0] == pytest.approx(b[m][0]) for m in a)
    plan = scoring.fold_predictions(df, w, 0, bounds)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
