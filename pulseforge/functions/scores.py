"""Scalar steps between logits, probabilities and decisions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid_probs(logits: Column) -> tuple[Column, Column]:
    """array<double> of logits -> probabilities, and whether every logit is finite."""
    probs = F.transform(logits, lambda x: 1 / (1 + F.exp(-x)))
    finite = F.forall(logits, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return probs, F.coalesce(finite, F.lit(False))


def impute_probs(probs: Column) -> Column:
    """NaN and null become 0, +Inf 1, -Inf 0."""
    inf = float("inf")
    return F.transform(probs, lambda x: F.when(x.isNull() | F.isnan(x) | (x == -inf), 0.0).when(x == inf, 1.0).otherwise(x))


def apply_thresholds(probs: Column, thresholds: list[float]) -> Column:
    """array<boolean>: probability, as double, at or above its class's threshold."""
    limits = F.array(*[F.lit(float(t)) for t in thresholds])
    return F.zip_with(probs, limits, lambda p, t: p.cast("double") >= t)


def valid_mask(length: Column, max_len: int) -> Column:
    """array<float>[max_len]: 1 where the index is below the length."""
    return F.transform(F.sequence(F.lit(0), F.lit(max_len - 1)), lambda i: F.when(i < length, 1.0).otherwise(0.0).cast("float"))
