"""Run leaderboards from a long table of (run_id, name, key, value)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Key prefixes of each kind, keys of older runs, and metrics of which less is better.
PREFIXES = {"bin": ["binaire_malade/"], "stat": ["stabilité/", "test_metrics/"], "perf": ["performance/"]}
LEGACY = {"AUPRC": "mean_auprc", "AUROC": "mean_auroc", "Accuracy": "acc_exact_match", "Challenge_Score": "challenge_score", "Macro_F1": "macro_f1"}
LOWER_IS_BETTER = ["temps_inference_sec", "hamming_loss", "mean_brier_score", "loss"]


def leaderboard(metrics: DataFrame, kind: str) -> DataFrame:
    """run_id, name, metric, mean, lower, upper, best: one row for each run and metric of the kind.

    Triples <m>_mean, <m>_ci_lower and <m>_ci_upper fold into one; a triple without a mean is left out. Less is
    better for loss, Brier, time and Hamming, more for all else; ties are all best.
    """
    key = F.coalesce(*[F.when(F.col("key").startswith(p), F.substring("key", len(p) + 1, 999)) for p in PREFIXES[kind]])
    if kind == "stat":
        older = F.create_map(*[F.lit(x) for pair in LEGACY.items() for x in pair])
        key = F.coalesce(key, F.element_at(older, F.col("key")))
    rows = metrics.withColumn("m", key).filter("m is not null and value is not null")
    if kind == "stat":
        part = F.when(F.col("m").endswith("_ci_lower"), "lower").when(F.col("m").endswith("_ci_upper"), "upper").otherwise("mean")
        rows = rows.withColumn("part", part).withColumn("m", F.when(F.col("m").rlike("_(mean|ci_lower|ci_upper)$"), F.regexp_replace("m", "_(mean|ci_lower|ci_upper)$", "")).otherwise(F.col("m")))
    else:
        rows = rows.withColumn("part", F.lit("mean"))
    of = lambda p: F.max(F.when(F.col("part") == p, F.col("value")))
    t = rows.groupBy("run_id", "name", F.col("m").alias("metric")).agg(of("mean").alias("mean"), of("lower").alias("lower"), of("upper").alias("upper")).filter("mean is not null")
    every = Window.partitionBy("metric")
    good = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.min("mean").over(every)).otherwise(F.max("mean").over(every))
    return t.withColumn("best", F.col("mean") == good)


def wide(board: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per run with a formatted column for each metric."""
    return format_metrics(board).groupBy("run_id", "name").pivot("metric", metrics).agg(F.first("shown")).na.fill("-", metrics)


def format_metrics(board: DataFrame) -> DataFrame:
    """board with shown: "%.3f", or "high / mean / low" where both bounds are known; "-" for null or NaN."""
    one = F.format_string("%.3f", F.col("mean"))
    three = F.format_string("%.3f / %.3f / %.3f", F.col("upper"), F.col("mean"), F.col("lower"))
    gone = F.col("mean").isNull() | F.isnan("mean")
    return board.withColumn("shown", F.when(gone, "-").when(F.col("upper").isNotNull() & F.col("lower").isNotNull(), three).otherwise(one))
