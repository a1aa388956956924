"""Multi-label evaluation. Predictions are rows of (rec_id, labels array<boolean>, probs array<double>).

Record-wise measures are column expressions over the arrays, so no record is shuffled; class-wise measures explode
the cells and are combined before the shuffle, which leaves one row for each class and task.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.scores import apply_thresholds
from ..shared import durable, keyed_hash
from .ranking import global_rank

NAN = float("nan")


def with_decisions(preds: DataFrame, thresholds: list[float]) -> DataFrame:
    return preds.withColumn("decided", apply_thresholds(F.col("probs"), thresholds))


def _both(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))


def cells(preds: DataFrame) -> DataFrame:
    """rec_id, class_idx, label, prob, and decided if there."""
    names = [c for c in ("labels", "probs", "decided") if c in preds.columns]
    rows = preds.select("rec_id", F.posexplode(F.arrays_zip(*names)).alias("class_idx", "x"))
    return rows.select("rec_id", "class_idx", *[F.col(f"x.{c}").alias({"labels": "label", "probs": "prob"}.get(c, c)) for c in names])


def confusion_per_class(preds: DataFrame, normalize: bool = False) -> DataFrame:
    """class_idx, tp, fp, fn, tn; normalised, a record weighs 1 / max(its labels, 1)."""
    weight = 1.0 / F.greatest(F.size(F.filter("labels", lambda x: x)), F.lit(1)) if normalize else F.lit(1).cast("long")
    rows = preds.select(weight.alias("w"), F.posexplode(F.arrays_zip("labels", "decided")).alias("class_idx", "x"))
    y, d = F.col("x.labels"), F.col("x.decided")
    of = {"tp": y & d, "fp": ~y & d, "fn": y & ~d, "tn": ~y & ~d}
    return rows.groupBy("class_idx").agg(*[F.sum(F.when(c, F.col("w")).otherwise(F.col("w") * 0)).alias(k) for k, c in of.items()])


def f_measure(preds: DataFrame) -> DataFrame:
    """class_idx, f1 (null without any of the class)."""
    d = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return confusion_per_class(preds).select("class_idx", F.when(d > 0, 2 * F.col("tp") / d).alias("f1"))


def macro_f1(preds: DataFrame) -> DataFrame:
    return f_measure(preds).agg(F.avg("f1").alias("macro_f1"))


def exact_match(preds: DataFrame) -> DataFrame:
    return preds.agg(F.avg((F.col("labels") == F.col("decided")).cast("int")).alias("exact_match"))


def hamming_loss(preds: DataFrame) -> DataFrame:
    wrong = _both(F.col("labels"), F.col("decided"), lambda a, b: (a != b).cast("int"))
    return preds.agg((F.sum(wrong) / F.sum(F.size("labels"))).alias("hamming_loss"))


def brier(preds: DataFrame) -> DataFrame:
    """class_idx, brier; class_idx -1 has the mean over all cells."""
    square = F.pow(F.col("prob") - F.col("label").cast("int"), F.lit(2))
    by = cells(preds).groupBy("class_idx").agg(F.sum(square).alias("s"), F.count("*").alias("n"))
    return by.select("class_idx", (F.col("s") / F.col("n")).alias("brier")).union(by.agg(F.lit(-1), F.sum("s") / F.sum("n")))


def _mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    d = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(d > 0, (tp.cast("double") * tn - fp.cast("double") * fn) / d).otherwise(0.0)


def mcc(preds: DataFrame) -> DataFrame:
    total = confusion_per_class(preds).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    return total.select(_mcc(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]).alias("mcc"))


def binary_sick(preds: DataFrame, nsr: int) -> DataFrame:
    """Sick: any class but nsr. One row of counts and rates."""
    other = lambda c: F.exists(F.filter(F.col(c), lambda x, i: i != nsr), lambda x: x)
    y, d = other("labels"), other("decided")
    n = lambda c: F.sum(c.cast("long"))
    t = preds.agg(n(y & d).alias("tp"), n(~y & d).alias("fp"), n(y & ~d).alias("fn"), n(~y & ~d).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return t.select(
        "tp", "fp", "fn", "tn",
        ratio(tp, tp + fn).alias("sensitivity"), ratio(tn, tn + fp).alias("specificity"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _mcc(tp, fp, fn, tn).alias("mcc"), ratio(tp + fn, tp + fp + fn + tn).alias("prevalence"),
    )


def roc_pr_auc(preds: DataFrame, steps: int = 32) -> DataFrame:
    """class_idx, auroc, auprc by descending distinct score. Cumulative in two levels: score ranges, then scores in a range.

    Ranges are steps of the log-odds, as scores of rare classes crowd near 0.
    """
    at = cells(preds).groupBy("class_idx", "prob").agg(F.sum(F.col("label").cast("long")).alias("p"), F.count("*").alias("n"))
    p = F.col("prob")
    at = at.withColumn("range", F.when(p <= 0, -(10**6)).when(p >= 1, 10**6).otherwise(F.floor(F.log(p / (1 - p)) * steps)))
    sums = at.groupBy("class_idx", "range").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    above = Window.partitionBy("class_idx").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("class_idx")
    sums = sums.select(
        F.col("class_idx").alias("__c"), F.col("range").alias("__r"),
        F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("n0"),
        F.sum("rp").over(whole).alias("all_p"), F.sum("rn").over(whole).alias("all_n"),
    )
    x = at.join(sums, (at["class_idx"] == sums["__c"]) & at["range"].eqNullSafe(sums["__r"]))
    here = Window.partitionBy("class_idx", "range").orderBy(F.desc("prob")).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("tp", F.col("p0") + F.sum("p").over(here)).withColumn("seen", F.col("n0") + F.sum("n").over(here))
    tpr = lambda tp: tp / F.greatest(F.col("all_p"), F.lit(1))
    tnr = lambda fp: (F.col("all_n") - F.col("all_p") - fp) / F.greatest(F.col("all_n") - F.col("all_p"), F.lit(1))
    fp = F.col("seen") - F.col("tp")
    step = tpr(F.col("tp")) - tpr(F.col("tp") - F.col("p"))
    roc = 0.5 * step * (tnr(fp) + tnr(fp - (F.col("n") - F.col("p"))))
    return x.groupBy("class_idx").agg(F.sum(roc).alias("auroc"), F.sum(step * F.col("tp") / F.greatest(F.col("seen"), F.lit(1))).alias("auprc"))


def macro_ap(preds: DataFrame) -> DataFrame:
    return roc_pr_auc(preds).agg(F.avg("auprc").alias("macro_ap"))


def pair_confusion(preds: DataFrame) -> DataFrame:
    """class_i (true), class_j (decided), a: the sum of 1 / |labels or decided| over records."""
    union = _both(F.col("labels"), F.col("decided"), lambda a, b: (a | b).cast("int"))
    which = lambda c: F.filter(F.transform(F.col(c), lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    rows = preds.select((1.0 / union).alias("w"), which("decided").alias("js"), F.explode(which("labels")).alias("class_i"))
    return rows.select("w", "class_i", F.explode("js").alias("class_j")).groupBy("class_i", "class_j").agg(F.sum("w").alias("a"))


def pair_sum(weights: list[list[float]], labels: Column, decided: Column) -> Column:
    """Sum of weights over true x decided pairs, divided by the union; NaN weights count nothing, nor does an empty union."""
    w = F.array(*[F.array(*[F.lit(0.0 if x != x else float(x)) for x in row]) for row in weights])
    row = lambda r: F.aggregate(F.zip_with(r, decided, lambda x, d: F.when(d, x).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    total = F.aggregate(F.zip_with(w, labels, lambda r, y: F.when(y, row(r)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    union = _both(labels, decided, lambda a, b: (a | b).cast("int"))
    return F.when(union > 0, total / union).otherwise(0.0)


def record_scores(preds: DataFrame, weights: list[list[float]], nsr: int) -> DataFrame:
    """preds with observed, correct and inactive: the record's parts of the challenge score."""
    only = F.transform("labels", lambda x, i: i == nsr)
    y = F.col("labels")
    return preds.withColumns({"observed": pair_sum(weights, y, F.col("decided")), "correct": pair_sum(weights, y, y), "inactive": pair_sum(weights, y, only)})


def score_of(observed: Column, correct: Column, inactive: Column) -> Column:
    """Equal but for rounding of sums means 0."""
    d = correct - inactive
    return F.when(F.abs(d) > 1e-12, (observed - inactive) / d).otherwise(0.0)


def challenge_score(preds: DataFrame, weights: list[list[float]], nsr: int) -> DataFrame:
    r = record_scores(preds, weights, nsr)
    return r.agg(score_of(F.sum("observed"), F.sum("correct"), F.sum("inactive")).alias("challenge_score"))


#: The cumulative Poisson(1) distribution.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]


#: Most leaves of the splitting tree, and records that a leaf should hold.
MOST_LEAVES, LEAF = 1 << 16, 1 << 13


def exact_sums(records: DataFrame, n: int, seed: int, leaves: int | None = None) -> DataFrame:
    """records (rec_id, stats array<double>) -> it, sums: of n resamples of N draws of N records each, with replacement.

    Records are dealt to the leaves of a binary tree by a hash of rec_id and counted. A resample's N draws are split down the tree
    by binomials of the counts, so that each leaf knows how many fall to it, and are drawn there, in the task that holds the
    leaf. Records are shuffled once, draws never. `leaves`, a power of two, follows from N if not given; rec_id must be unique.
    """
    spark = records.sparkSession
    hashed = keyed_hash(seed, F.col("rec_id"))
    counts = np.zeros(MOST_LEAVES, dtype=np.int64)
    for r in records.groupBy((hashed % MOST_LEAVES).alias("leaf")).count().collect():  # MOST_LEAVES rows at most
        counts[r.leaf] = r["count"]
    leaves = leaves or min(1 << max(int(counts.sum()) // LEAF, 1).bit_length(), MOST_LEAVES)
    counts = counts.reshape(-1, leaves).sum(axis=0)
    shared = spark.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total, held, at = shared.value, None, [], -1

        def add() -> None:
            nonlocal total, held
            if held:
                stats = np.concatenate(held)
                if len(stats) != counts[at]:
                    raise RuntimeError(f"leaf {at} has {len(stats)} records, not {counts[at]}")
                drawn = draws.local_counts(draws.draws_of_leaf(counts, at, n, seed), at, leaves, len(stats), seed)
                total = drawn @ stats if total is None else total + drawn @ stats
                held = []

        for b in batches:
            if not b.num_rows:
                continue
            of = b.column(0).to_numpy()
            stats = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), b.num_rows]
            for start, end in zip(edges, edges[1:]):
                if of[start] != at:
                    add()
                    at = int(of[start])
                held.append(stats[start:end].copy())
        add()
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(list(total))], ["it", "sums"])

    dealt = records.select((hashed % leaves).cast("int").alias("leaf"), "rec_id", "stats")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(min(parts, leaves), "leaf").sortWithinPartitions("leaf", "rec_id").select("leaf", "stats")
    return _added(dealt.mapInArrow(run, "it int, sums array<double>"))


def _added(wide: DataFrame) -> DataFrame:
    """it, sums: the tasks' sums added up."""
    long = wide.select("it", F.posexplode("sums").alias("k", "x")).groupBy("it", "k").agg(F.sum("x").alias("x"))
    return long.groupBy("it").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda v: v["x"]).alias("sums"))


def poisson_draws(records: DataFrame, n: int, seed: int) -> DataFrame:
    """times (array<tinyint>, for each resample), stats: each record Poisson(1) times, which N draws of N tend to; nothing is looked
    up elsewhere. The chance is keyed_hash(seed, resample, rec_id), of a batch of records at once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            times = draws.poisson_counts(b.column(0).to_pylist(), n, seed, POISSON)
            flat = pa.array(np.ascontiguousarray(times.T).view(np.int8).ravel())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * n), flat), b.column(1)], ["times", "stats"])

    key = F.coalesce(F.col("rec_id").cast("string"), F.lit("")).cast("binary")
    return records.select(key.alias("key"), "stats").mapInArrow(run, "times array<tinyint>, stats array<double>")


def resample_sums(rows: DataFrame, n: int) -> DataFrame:
    """rows (times, stats array<double>) -> it, sums array<double>: one matrix product for a batch, n rows for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            stats = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            times = b.column(0).flatten().to_numpy().reshape(b.num_rows, n).T.astype(np.float64)
            total = times @ stats if total is None else total + times @ stats
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(list(total))], ["it", "sums"])

    return _added(rows.select("times", "stats").mapInArrow(run, "it int, sums array<double>"))


def bootstrap_ci(preds: DataFrame, weights: list[list[float]], nsr: int, n: int = 100, seed: int = 42, poisson: bool = False, leaves: int | None = None) -> DataFrame:
    """metric, mean, lower, upper over n resamples of the records: N draws of N with replacement, or with `poisson`, for very
    many records, a Poisson(1) number of each. What a resample needs of a record is one short vector of numbers.
    """
    k = len(weights)
    if poisson:  # each record costs n draws, and a table may be one split
        parts = int(preds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        preds = preds.select("rec_id", "labels", "decided").repartition(parts, "rec_id")
    r = record_scores(preds, weights, nsr)
    wrong = _both(F.col("labels"), F.col("decided"), lambda a, b: (a != b).cast("int"))
    bits = [F.zip_with("labels", "decided", f) for f in (lambda y, d: (y & d).cast("double"), lambda y, d: (~y & d).cast("double"), lambda y, d: (y & ~d).cast("double"))]
    head = F.array(*[c.cast("double") for c in (F.col("observed"), F.col("correct"), F.col("inactive"), wrong, F.size("labels"))])
    records = r.select("rec_id", F.concat(head, *bits).alias("stats"))
    by = resample_sums(poisson_draws(records, n, seed), n) if poisson else exact_sums(records, n, seed, leaves)
    at = lambda i: F.col("sums")[i]
    f1 = []
    for i in range(k):
        tp, fp, fn = at(5 + i), at(5 + k + i), at(5 + 2 * k + i)
        f1.append(F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)))
    f1 = F.array_compact(F.array(*f1))
    by = by.select("it", score_of(at(0), at(1), at(2)).alias("challenge"), (F.aggregate(f1, F.lit(0.0), lambda s, v: s + v) / F.size(f1)).alias("macro_f1"), (at(3) / at(4)).alias("hamming_loss"))
    long = by.unpivot("it", ["challenge", "macro_f1", "hamming_loss"], "metric", "v")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.percentile("v", F.lit(0.025)).alias("lower"), F.percentile("v", F.lit(0.975)).alias("upper"))


def per_class_report(preds: DataFrame) -> DataFrame:
    c = confusion_per_class(preds)
    d = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    c = c.select("class_idx", F.when(d > 0, 2 * F.col("tp") / d).alias("f1"), (F.col("tp") / (F.col("tp") + F.col("fn") + 1e-9)).alias("recall"), (F.col("tn") / (F.col("tn") + F.col("fp") + 1e-9)).alias("specificity"))
    return c.join(roc_pr_auc(preds), "class_idx").join(brier(preds), "class_idx")


def evaluation_summary(preds: DataFrame, thresholds: dict[str, list[float]], weights: list[list[float]], nsr: int) -> DataFrame:
    """One row; each metric under the thresholds tuned for it: challenge, f1, mcc. One scan for the areas, one for all else."""
    of = {m: apply_thresholds(F.col("probs"), t) for m, t in thresholds.items()}
    rows = preds.select("labels", "probs", of["challenge"].alias("decided"), of["f1"].alias("for_f1"), of["mcc"].alias("for_mcc"))
    r = record_scores(rows, weights, nsr)
    y, k = F.col("labels"), len(weights)
    square = F.aggregate(F.zip_with("labels", "probs", lambda a, p: F.pow(p - a.cast("int"), F.lit(2))), F.lit(0.0), lambda s, x: s + x)
    sums = [F.sum(c).alias(c) for c in ("observed", "correct", "inactive")] + [F.sum(square).alias("square"), F.sum(F.size(y)).alias("cells")]
    sums += [F.avg((y == F.col("decided")).cast("int")).alias("exact_match")]
    for i in range(k):
        a, d = y[i], F.col("for_f1")[i]
        sums += [F.sum((a & d).cast("long")).alias(f"tp_{i}"), F.sum((a != d).cast("long")).alias(f"wrong_{i}")]
    sides = {"tp": lambda a, d: a & d, "fp": lambda a, d: ~a & d, "fn": lambda a, d: a & ~d, "tn": lambda a, d: ~a & ~d}
    sums += [F.sum(_both(y, F.col("for_mcc"), f)).alias(c) for c, f in sides.items()]
    t = r.agg(*sums)
    f1 = [F.when(2 * F.col(f"tp_{i}") + F.col(f"wrong_{i}") > 0, 2 * F.col(f"tp_{i}") / (2 * F.col(f"tp_{i}") + F.col(f"wrong_{i}"))) for i in range(k)]
    f1 = F.array_compact(F.array(*f1))
    t = t.select(
        score_of(F.col("observed"), F.col("correct"), F.col("inactive")).alias("challenge_score"),
        (F.aggregate(f1, F.lit(0.0), lambda s, v: s + v) / F.size(f1)).alias("macro_f1"),
        _mcc(*[F.col(c) for c in sides]).alias("mcc"), "exact_match", (F.col("square") / F.col("cells")).alias("brier"),
    )
    auc = roc_pr_auc(preds).agg(F.avg("auroc").alias("mean_auroc"), F.avg("auprc").alias("mean_auprc"))
    return t.crossJoin(auc)  # of one row each
