"""Semantics on hand-made rows."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pulseforge.functions import labels, scores
from pulseforge.operators import inventory as inv
from pulseforge.operators import metrics, ranking, report, scoring, signals
from pulseforge.sources import normalized, recordings, tables


def test_labels(spark):
    rows = [(1, ["713427006", "59118001"]), (2, ["426177001", "426627000"]), (3, ["426627000"]), (4, ["999"]), (5, []), (6, None), (7, ["270492004", " 427084000"])]
    df = spark.createDataFrame(rows, "id int, codes array<string>").select("id", labels.derive_labels(F.col("codes")).alias("y"))
    got = {r.id: {c for c, v in zip(labels.CLASSES, r.y, strict=True) if v} for r in df.collect()}
    assert got == {1: {"RBBB"}, 2: {"SB"}, 3: {"Brady"}, 4: set(), 5: set(), 6: set(), 7: {"1dAVb", "ST"}}


def test_conform_truncates_and_raises_on_text(spark):
    df = spark.createDataFrame([(1, 1.9), (2, None)], "id int, a double")
    assert [(r.a, r.b) for r in labels.conform_labels(df, ["a", "b"]).orderBy("id").collect()] == [(1.0, 0.0), (0.0, 0.0)]
    bad = spark.createDataFrame([(1, "true")], "id int, a string")
    with pytest.raises(PySparkException):
        labels.conform_labels(bad, ["a"]).collect()


def test_class_weights_edges(spark):
    df = spark.createDataFrame([("True", None, ["a", "b"]), ("1", "x", ["a", "b"]), ("true ", None, ["a"])], "a string, b string, source_classes array<string>").withColumn("c", F.lit(None).cast("string"))
    got = {r["class"]: (r.total, r.positives, r.pos_weight) for r in labels.class_weights(df, ["a", "b", "c"]).collect()}
    assert got == {"a": (3, 2, 0.5), "b": (2, 0, 2.0), "c": (0, 0, 1.0)}


def test_headers(spark):
    text = [
        ("/d/set1/g1/A1.hea", "A1 12 bad 5000\nlead 16 250\n# Age:\t63\n# Sex:\tMale\t\r\n# Dx: 1,2\n \t# Dx:\t3,\t4\t"),
        ("/d/set2/g2/B2.hea", "B2 12 500\n#Age: 5\n# Age: NaN\n# Dx: 9"),
        ("/d/set2/g2/C3.hea", "C3 12\n# Age: old\n# Sex: F"),
    ]
    r = {x.exam_id: x for x in recordings.parse_headers(spark.createDataFrame(text, "path string, value string")).collect()}
    assert (r["A1"].dataset, r["A1"].freq, r["A1"].age, r["A1"].is_male, r["A1"].codes) == ("set1", 250.0, 63.0, True, ["3", "4"])
    assert r["B2"].freq == 500 and np.isnan(r["B2"].age) and r["B2"].is_male is None
    assert r["C3"].freq is None and r["C3"].age is None and r["C3"].is_male is False


def test_recordings_from_files(spark, tmp_path):
    d = tmp_path / "set1" / "g1"
    d.mkdir(parents=True)
    (d / "E1.hea").write_text("E1 2 500 3\nE1.dat 16 200(0)/mV 16 0 0\nE1.dat 16 100(-5)/mV 16 0 0\n# Age: 5\n")
    (d / "E1.dat").write_bytes(np.array([[200, 95], [400, -5], [-200, 195]], dtype="<i2").tobytes())
    (r,) = recordings.read_recordings(spark, str(tmp_path)).collect()
    assert r.tracing == [[1.0, 2.0, -1.0], [1.0, 0.0, 2.0]]
    assert recordings.read_headers(spark, str(tmp_path)).first().freq == 500


def test_weight_matrix_checks_names(spark, tmp_path):
    (tmp_path / "w.csv").write_text(" , A,B\t\nA ,\t1.0 , x\nB, inf,0.5 \n")
    m = tables.weights_of(tables.read_weight_matrix(spark, str(tmp_path / "w.csv")), ["A", "B"])
    assert m[0][0] == 1.0 and m[1][1] == 0.5 and np.isnan(m[0][1]) and np.isnan(m[1][0])
    (tmp_path / "v.csv").write_text(",A,B\nA,1.0,2\nC,1,0.5\n")
    with pytest.raises(ValueError):
        tables.read_weight_matrix(spark, str(tmp_path / "v.csv"))


def test_metadata_with_different_headers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "x.csv").write_text("exam_id, AF,nn_predicted_age\n1,True,\n")
    (tmp_path / "b" / "y.csv").write_text("exam_id,NSR\n2,False\n")
    m = tables.read_metadata(spark, [str(tmp_path / "a"), str(tmp_path / "b")], ["AF", "NSR"])
    (tmp_path / "b" / "z.csv").write_bytes(b"\xef\xbb\xbf\n\n , \nexam_id , NSR\n3,\"a,\n b\"\n\n4\n5,x,extra\n")
    m = tables.read_metadata(spark, [str(tmp_path / "a"), str(tmp_path / "b")], ["AF", "NSR"], batch_rows=2)
    assert {r.exam_id: r.NSR for r in m.collect()} == {"1": None, "2": "False", "3": "a,\n b", "4": None, "5": "x"}
    (tmp_path / "b" / "z.csv").unlink()
    m = tables.read_metadata(spark, [str(tmp_path / "a"), str(tmp_path / "b")], ["AF", "NSR"])
    assert set(m.columns) == {"exam_id", "AF", "NSR", "source_classes"}
    assert {r.exam_id: r.source_classes for r in m.collect()} == {"1": ["AF"], "2": ["NSR"]}


def test_reading_headers_takes_their_bytes_alone(spark, tmp_path):
    (tmp_path / "long.csv").write_text("\nid,AF\n" + "1,x\n" * 3_000_000)
    read = []

    class Counted:
        def __init__(self, raw):
            self.raw = raw

        def __enter__(self):
            import io

            outer = self

            class Raw(io.RawIOBase):
                def readable(self):
                    return True

                def readinto(self, b):
                    got = outer.raw.read(len(b))
                    read.append(len(got))
                    b[: len(got)] = got
                    return len(got)

            return io.BufferedReader(Raw())

        def __exit__(self, *_):
            self.raw.close()

    class Where:
        def open_input_stream(self, path):
            return Counted(open(path, "rb"))

    before, tables.file_system = tables.file_system, lambda path: (Where(), path)
    try:
        assert tables._header(tables._csv_rows(str(tmp_path / "long.csv"))) == ["id", "AF"]
    finally:
        tables.file_system = before
    assert sum(read) < 100_000
    plan = tables.headers_of(tables.metadata_files(spark, [str(tmp_path)]))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1]


def test_pairs_are_of_one_folder(spark):
    s = spark.createDataFrame([("a/E1.dat",), ("b/E1.dat",), ("b/E2.x.dat",)], "path string")
    m = spark.createDataFrame([("a/E1.csv",), ("b/E1.csv",), ("a/E2.x.csv",)], "path string")
    got = {(r.name, r.signal_path, r.meta_path, r.has_meta) for r in tables.source_pairs(s, m).collect()}
    assert got == {("E1", "a/E1.dat", "a/E1.csv", True), ("E1", "b/E1.dat", "b/E1.csv", True), ("E2.x", "b/E2.x.dat", None, False)}


def test_a_source_is_read_from_its_last_whole_run(spark, tmp_path):
    path = str(tmp_path / "n")
    rows = [("007", "a", 1), ("007", "b", 2), (None, "c", 3), ("x", "d", 4)]
    df = spark.createDataFrame(rows, "source string, exam_id string, v int")
    normalized.write_normalized(df, path)
    read = lambda: sorted(((r.source, r.exam_id, r.v) for r in normalized.read_normalized(spark, path).collect()), key=repr)
    assert read() == sorted(rows, key=repr)
    normalized.write_run(df.withColumn("v", F.lit(9)), path)
    assert read() == sorted(rows, key=repr)
    normalized.write_normalized(df.filter("source = '007'").withColumn("v", F.col("v") + 10), path)
    normalized.write_normalized(df.filter("source is null").withColumn("v", F.col("v") + 20), path)
    want = sorted([("007", "a", 11), ("007", "b", 12), (None, "c", 23), ("x", "d", 4)], key=repr)
    assert read() == want
    assert normalized.clear_normalized(spark, path) == 5 and read() == want
    assert normalized.clear_normalized(spark, path) == 0
    plan = normalized.read_normalized(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_center_pad(spark):
    df = spark.createDataFrame([("a", [[0.0] + [1.0] * 4], 1, 4), ("b", [[1.0] * 5], 0, 5)], "exam_id string, tracing array<array<float>>, start_offset int, length int")
    got = {r.exam_id: r.tracing[0] for r in signals.center_pad(df, 10).collect()}
    assert got["a"] == [0.0] * 3 + [1.0] * 4 + [0.0] * 3 and got["b"] == [0.0] * 2 + [1.0] * 5 + [0.0] * 3
    with pytest.raises(PySparkException):
        signals.center_pad(df.withColumn("length", F.lit(15)), 10).collect()


def test_audit_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("nan", [[nan, nan]]), ("mix", [[nan, -5e-5]]), ("inf", [[-inf, 1.0]]), ("big", [[70000.0, 0.0]]), ("none", None), ("zero", [[]])]
    got = {r.source: r for r in signals.audit_signals(spark.createDataFrame(rows, "source string, tracing array<array<float>>")).collect()}
    assert got["nan"].status == "only NaN" and got["nan"].min_value is None
    assert got["mix"].has_nan and got["mix"].has_underflow and got["mix"].max_value == pytest.approx(-5e-5)
    assert got["inf"].has_inf and got["inf"].min_value == -inf
    assert got["big"].has_overflow and got["none"].status == "missing" and got["zero"].status == "zero dimension"


def test_normalized_synthetic_exams_are_valid(spark):
    leads = spark.createDataFrame([(k, 40.0, 100.0) for k in range(3)], "lead int, amplitude double, offset double")
    x = signals.synthetic_exams(spark.range(2).withColumnRenamed("id", "key"), leads)
    x = x.withColumn("source", F.lit("s")).withColumn("collection", F.lit("D1"))
    n = signals.normalize_signals(x)
    assert all(r.length == 800 for r in n.collect())
    assert signals.norm_quality(n).filter("valid").count() == 10


def test_ranks_do_not_depend_on_partitions(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), (F.col("id") % 3).alias("g"))
    for n in ("1", "4", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert all(r["rank"] == r.k for r in ranking.global_rank(df, ["k"]).collect())
        within = ranking.global_rank(df, ["k"], ["g"]).orderBy("g", "k").collect()
        assert all(b["rank"] == a["rank"] + 1 if a.g == b.g else b["rank"] == 0 for a, b in zip(within, within[1:]))
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_split_shards_and_batches(spark):
    rows = [(i, i % 40 if i % 41 else None, i * 37 % 200) for i in range(1000)]
    df = spark.createDataFrame(rows, "exam_id long, patient_id long, length int")
    split = inv.patient_split(df)
    assert split.groupBy("patient_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert split.filter("patient_id is null and split <> 'test'").count() == 0
    assert split.filter("split = 'train'").select("patient_id").distinct().count() == 32
    shards = inv.assign_shards(inv.length_buckets(split, 64), 100)
    assert shards.count() == 1000
    for _, group in shards.toPandas().groupby("split"):
        assert sorted(group.pos) == list(range(len(group)))
        sizes = group.groupby("shard_id").size()
        assert len(sizes) == -(-len(group) // 100) and sizes.max() - sizes.min() <= 1
    few = inv.patient_split(df.filter("patient_id < 5"))
    assert few.filter("split = 'val'").count() == 0


def test_batches_drop_the_single_and_the_short(spark):
    rows = [(i, "train", 0, i, 100) for i in range(65)] + [(100 + i, "val", 0, i, 40) for i in range(10)]
    df = spark.createDataFrame(rows, "exam_id long, split string, shard_id long, pos long, length int")
    got = inv.batch_plan(df, train=False).collect()
    assert [(r.split, r.n_rows, r.width) for r in got] == [("train", 64, 100)]


def test_align_raises_on_repeated_ids(spark):
    s = spark.createDataFrame([("a",), ("b",)], "exam_id string")
    m = spark.createDataFrame([("a", 1)], "exam_id string, age int")
    assert {(r.exam_id, r.age) for r in inv.align_metadata(s, m).collect()} == {("a", 1), ("b", None)}
    with pytest.raises(PySparkException):
        inv.align_metadata(s, m.union(m)).collect()


def test_scores(spark):
    df = spark.createDataFrame([([float("nan"), float("inf"), -float("inf"), 0.3],)], "p array<double>")
    assert df.select(scores.impute_probs(F.col("p"))).first()[0] == [0.0, 1.0, 0.0, 0.3]


def _preds(spark, n=200, k=4, seed=5):
    rng = np.random.default_rng(seed)
    y = rng.random((n, k)) < 0.3
    p = np.round(rng.random((n, k)) * 0.6 + y * 0.2, 2)
    y[:5] = False
    rows = [(i, [bool(v) for v in y[i]], [float(v) for v in p[i]]) for i in range(n)]
    return y, p, spark.createDataFrame(rows, "rec_id long, labels array<boolean>, probs array<double>")


def _challenge(w, y, d, nsr):
    def total(o):
        a = np.zeros_like(w)
        for r, q in zip(y, o):
            if (r | q).any():
                a += np.outer(r, q) / (r | q).sum()
        return np.nansum(w * a)

    inactive = np.zeros_like(y)
    inactive[:, nsr] = True
    o, c, n = total(d), total(y), total(inactive)
    return 0.0 if c == n else (o - n) / (c - n)


def test_challenge_with_nan_weights(spark):
    y, p, df = _preds(spark)
    w = np.eye(4) + 0.25
    w[1, 2] = np.nan
    got = metrics.challenge_score(metrics.with_decisions(df, [0.4] * 4), w.tolist(), 0).first()[0]
    assert got == pytest.approx(_challenge(w, y, p >= 0.4, 0))


def test_auc_edges(spark):
    rows = [(i, [False, True, i % 2 == 0], [0.5, 0.5, 0.1]) for i in range(10)]
    df = spark.createDataFrame(rows, "rec_id long, labels array<boolean>, probs array<double>")
    got = {r.class_idx: (r.auroc, r.auprc) for r in metrics.roc_pr_auc(df).collect()}
    assert got[0] == (0.0, 0.0) and got[2] == (0.5, 0.5)


def test_tuning_is_the_exhaustive_search(spark):
    y, p, df = _preds(spark, 60, 3)
    w = np.eye(3) * 0.5 + 0.5 - np.abs(np.subtract.outer(range(3), range(3))) * 0.1
    candidates = scoring.CANDIDATES[::9]
    got = scoring.tune_thresholds(df, w.tolist(), 0, epochs=2, candidates=candidates)
    now, best = [0.5] * 3, {}
    for _ in range(2):
        for i in range(3):
            top = -np.inf
            start = now[i]
            for c in candidates:
                t = list(now)
                t[i] = c
                d = p >= np.array(t)
                tp, fp, fn = (y & d).sum(0), (~y & d).sum(0), (y & ~d).sum(0)
                f1 = np.mean([2 * a / (2 * a + b + e) for a, b, e in zip(tp, fp, fn) if 2 * a + b + e])
                v = {"challenge_score": round(_challenge(w, y, d, 0), 12), "macro_f1": round(f1, 12)}
                if v["challenge_score"] > top:
                    top, start = v["challenge_score"], c
                for m, s in v.items():
                    if s > best.get(m, (-np.inf,))[0]:
                        best[m] = (s, t)
            now[i] = start
    for m, (s, t) in best.items():
        assert got[m][0] == pytest.approx(s) and got[m][1] == t


def test_leaderboard(spark):
    rows = [("r1", "m", "stabilité/hamming_loss_mean", 0.2), ("r2", "m", "stabilité/hamming_loss_mean", 0.1), ("r1", "m", "stabilité/x_ci_lower", 1.0), ("r1", "m", "AUPRC", 0.5), ("r2", "m", "AUPRC", 0.5), ("r2", "m", "test_metrics/y", None)]
    got = {(r.run_id, r.metric): r.best for r in report.leaderboard(spark.createDataFrame(rows, "run_id string, name string, key string, value double"), "stat").collect()}
    assert got == {("r1", "hamming_loss"): False, ("r2", "hamming_loss"): True, ("r1", "mean_auprc"): True, ("r2", "mean_auprc"): True}
