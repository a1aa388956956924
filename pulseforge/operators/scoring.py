"""Scoring signal batches with any model, and tuning a threshold for each class."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..shared import durable
from .inventory import BATCH
from .metrics import NAN, cells
from .signals import kept_records, mark_rejects, matrices, n_samples

#: The candidates 0.05, 0.06, .. 0.50 as the doubles that a step of 0.01 gives.
CANDIDATES = np.arange(0.05, 0.51, 0.01).tolist()


def padded(tracings: pa.ListArray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """float32 rows x leads x width with each row's active part at the left, and the mask of what is valid, from flat buffers."""
    found = list(matrices(tracings))
    x = np.zeros((len(found), max(len(m) for m in found), width), dtype=np.float32)
    mask = np.zeros((len(found), width), dtype=np.float32)
    for k, (m, start, n) in enumerate(zip(found, starts.tolist(), lengths.tolist(), strict=True)):
        n = max(min(n, width, m.shape[1] - start), 0)
        x[k, : len(m), :n] = m[:, start : start + n]
        mask[k, :n] = 1
    return x, mask


def score_batches(plan: DataFrame, signals: DataFrame, load_model: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> DataFrame:
    """rec_id, labels, probs, finite, width of the plan's rows.

    plan: rows of planned_rows (exam_id, labels, length, start_offset, width, place and the batch's keys); signals: exam_id, tracing.
    Rows are dealt by batch, so each batch is in one task and in order, and the model is called once a batch with a tensor of its
    width and the mask of valid samples. Where plan and signals are bucketed alike (sources.shards) that is the only shuffle. The model is loaded once for each task. Exams without a tracing, without
    samples, or with leads of different lengths, are skipped, and do not change the width.
    """
    keys = [*BATCH, "place"]
    usable = kept_records(mark_rejects(signals.select("exam_id", "tracing"))).filter(n_samples() > 0)
    rows = plan.select("exam_id", "labels", "length", "start_offset", "width", *keys).join(usable, "exam_id")
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, *BATCH).sortWithinPartitions(*keys)
    shape = ["exam_id", "labels", "width"]
    schema = rows.select(F.col("exam_id").alias("rec_id"), "labels").schema.add("probs", ArrayType(DoubleType())).add("finite", "boolean").add("width", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model()

        def scored(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            width = t["width"][0].as_py()
            x, mask = padded(t["tracing"].combine_chunks(), t["start_offset"].to_numpy(), t["length"].to_numpy(), width)
            logits = np.asarray(model(x, mask), dtype=np.float64)
            with np.errstate(over="ignore"):
                probs = 1 / (1 + np.exp(-logits))
            finite = pa.array(np.isfinite(logits).all(axis=1))
            columns = [t["exam_id"].combine_chunks(), t["labels"].combine_chunks(), pa.array(list(probs), pa.list_(pa.float64())), finite, pa.array([width] * len(t), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        held: list[pa.RecordBatch] = []
        at = None
        for b in batches:
            of = list(zip(*[b.column(len(shape) + k).to_pylist() for k in range(len(BATCH))], strict=True))
            start = 0
            for k, key in enumerate(of):
                if key != at:
                    if k > start:
                        held.append(b.slice(start, k - start))
                    if held:
                        yield scored(held)
                    held, at, start = [], key, k
            if b.num_rows > start:
                held.append(b.slice(start))
        if held:
            yield scored(held)

    return dealt.select(*shape, *BATCH, "start_offset", "length", "tracing").mapInArrow(run, schema)


def fold_predictions(preds: DataFrame, weights: list[list[float]], nsr: int, bounds: list[float]) -> DataFrame:
    """signature, n, correct, inactive: records of equal labels and, class by class, equal intervals between bounds, counted.

    A signature is the labels and then the intervals, a byte each: how many bounds the probability reaches (none for NaN or null).
    """
    if len(bounds) > 255:
        raise ValueError("more than 255 bounds")
    k = len(weights)
    w = np.array([[0.0 if x != x else x for x in row] for row in weights])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(-1, k)
            p = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            steps = np.searchsorted(bounds, p, side="right")
            steps[np.isnan(p)] = 0
            packed = np.concatenate([y, steps], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in packed], pa.binary())], ["signature"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, _ = read_signatures(b.column(0), k)
            row = y @ w
            correct = np.divide((row * y).sum(axis=1), y.sum(axis=1), out=np.zeros(len(y)), where=y.any(axis=1))
            inactive = row[:, nsr] / (y.sum(axis=1) + ~y[:, nsr])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(correct), pa.array(inactive)], ["signature", "n", "correct", "inactive"])

    rows = preds.select("labels", F.transform("probs", lambda p: F.coalesce(p.cast("double"), F.lit(NAN))).alias("probs"))
    folded = rows.mapInArrow(signed, "signature binary").groupBy("signature").agg(F.count("*").alias("n"))
    return folded.mapInArrow(parts, "signature binary, n long, correct double, inactive double")


def read_signatures(column: pa.BinaryArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels (bool) and intervals (uint8) of fold_predictions' signatures, rows by k."""
    both = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, 2 * k)
    return both[:, :k].astype(bool), both[:, k:]


def interval_sums(folded: DataFrame, weights: list[list[float]], now: list[int], i: int, steps: int) -> np.ndarray:
    """What class i's candidates need, a row for each of its intervals: sums over the records whose probability falls there of observed
    with the class decided and not, correct, inactive, records, and by class positives, tp and fp (those of class i are filled in
    later). `now` has how many bounds a probability must reach to be decided. One matrix product for a batch; `steps` rows a task.
    """
    w = np.array([[0.0 if x != x else x for x in row] for row in weights])
    k = len(now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((steps, 5 + 3 * k))
        for b in batches:
            y, of = read_signatures(b.column(0), k)
            d = of >= np.array(now)
            d[:, i] = False
            row, off = y @ w, (y | d).sum(axis=1)
            low, on = (row * d).sum(axis=1), off + ~y[:, i]
            values = [(low + row[:, i]) / on, np.divide(low, off, out=np.zeros(len(y)), where=off > 0), b.column(2).to_numpy(), b.column(3).to_numpy(), np.ones(len(y)), *y.T, *(y & d).T, *(~y & d).T]
            n = b.column(1).to_numpy()
            for c, v in enumerate(values):
                total[:, c] += np.bincount(of[:, i], weights=v * n, minlength=steps)
        yield pa.RecordBatch.from_arrays([pa.array(range(steps), pa.int32()), pa.array(list(total))], ["step", "sums"])

    wide = folded.mapInArrow(run, "step int, sums array<double>")
    sums = wide.groupBy("step").agg(F.array(*[F.sum(F.col("sums")[c]) for c in range(5 + 3 * k)]).alias("sums"))
    out = np.zeros((steps, 5 + 3 * k))
    for r in sums.collect():  # a row for each interval
        out[r.step] = r.sums
    return out


def tune_thresholds(preds: DataFrame, weights: list[list[float]], nsr: int, epochs: int = 3, candidates: list[float] = CANDIDATES) -> dict[str, tuple[float, list[float]]]:
    """metric -> (score, thresholds) for challenge_score, macro_f1 and mcc seen on the challenge-driven path.

    All that the search asks of a record is its labels and between which candidates its probabilities lie, so records are folded to
    such signatures once, and each step runs over the distinct ones. One class is tuned at a time: only its bit differs between
    candidates, so one aggregate by interval answers them all. Of equal scores the smallest candidate wins.
    """
    k = len(weights)
    candidates = sorted(candidates)
    bounds = sorted({*candidates, 0.5})
    reach = [bounds.index(c) + 1 for c in candidates]  # how many bounds a probability reaches from a candidate on
    now = [bounds.index(0.5) + 1] * k
    folded = durable(fold_predictions(preds, weights, nsr, bounds), "tuning")
    best = {m: (-np.inf, [0.5] * k) for m in ("challenge_score", "macro_f1", "mcc")}
    for i in [*range(k)] * epochs:
        sums = interval_sums(folded, weights, now, i, len(bounds) + 1)
        # above[c]: records whose probability reaches candidate c
        above = sums[::-1].cumsum(axis=0)[::-1][reach]
        whole = sums.sum(axis=0)
        observed = above[:, 0] + (whole - above)[:, 1]
        correct, inactive, n = whole[2], whole[3], whole[4] * k
        chal = (observed - inactive) / (correct - inactive) if abs(correct - inactive) > 1e-12 else np.zeros(len(candidates))
        p, tp, fp = (np.tile(whole[5 + j * k : 5 + (j + 1) * k], (len(candidates), 1)) for j in range(3))
        tp[:, i], fp[:, i] = above[:, 5 + i], above[:, 4] - above[:, 5 + i]
        any_of = tp + fp + p
        with np.errstate(invalid="ignore", divide="ignore"):
            f1 = np.where(any_of > 0, 2 * tp / any_of, np.nan)
            f1 = np.nanmean(f1, axis=1) if (any_of > 0).any() else np.full(len(candidates), NAN)
            a, b, e = (x.sum(axis=1) for x in (tp, fp, p))
            den = np.sqrt((a + b) * e * (n - e) * (n - a - b))
            mcc = np.where(den > 0, (a * (n - b - e) - b * (e - a)) / den, 0.0)
        for m, found in (("challenge_score", chal), ("macro_f1", f1), ("mcc", mcc)):
            found = np.round(found, 12)
            if (found > best[m][0]).any():
                c = int(np.nanargmax(found))
                best[m] = (float(found[c]), [bounds[r - 1] for r in [*now[:i], reach[c], *now[i + 1 :]]])
        now[i] = reach[int(np.argmax(np.round(chal, 12)))]
    return best


def threshold_table(spark, found: dict[str, tuple[float, list[float]]]) -> DataFrame:
    rows = [(m, c, float(t), float(s)) for m, (s, ts) in found.items() for c, t in enumerate(ts)]
    return spark.createDataFrame(rows, "metric string, class_idx int, threshold double, score double")


def probability_intervals(preds: DataFrame, candidates: list[float] = CANDIDATES) -> DataFrame:
    """class_idx, step, n, positives: how many cells each candidate interval holds."""
    step = sum((F.when(F.col("prob") >= c, 1).otherwise(0) for c in candidates), F.lit(0))
    return cells(preds).groupBy("class_idx", step.alias("step")).agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("positives"))
