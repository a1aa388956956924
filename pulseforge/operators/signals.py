"""Signal operators. A row is one exam with tracing: array<array<float>> by lead, ragged, no padding stored.

Array forms run numpy over Arrow batches, without a shuffle: a batch's samples are one flat buffer, of which an exam's matrix is
a view, and results are put together as flat buffers. The width of each source, which sets the baseline's kernel, is one
slim aggregate looked up in a broadcast of checked size. Long forms take (exam_id, lead, t, x) and are windows over an exam's lead.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructType

from ..functions import kernels
from ..shared import durable

#: Most sources whose widths are broadcast; more are joined. Bytes of samples in a batch given back, and in one of test exams.
BROADCAST_SOURCES, BATCH_BYTES, TEST_BYTES = 100_000, 1 << 26, 1 << 22


def matrices(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    """Leads by samples of each row, float64; of a null row none. None stands for an exam whose leads are not of one length."""
    leads = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    inner = column.flatten()
    sizes = pc.fill_null(pc.list_value_length(inner), 0).to_numpy()
    flat = inner.flatten().to_numpy(zero_copy_only=False)
    at = k = 0
    for n in leads:
        of = sizes[k : k + n]
        wide = int(of[0]) if n else 0
        size = int(of.sum())
        yield flat[at : at + size].reshape(n, wide).astype(np.float64) if (of == wide).all() else None
        at, k = at + size, k + n


def list_column(rows: list[np.ndarray | None], kind: str = "float") -> pa.ListArray:
    """array<array<kind>> of matrices; None is null."""
    found = [x for x in rows if x is not None]
    flat = np.concatenate([np.zeros(0), *[x.ravel() for x in found]], dtype=np.float32 if kind == "float" else np.float64, casting="same_kind")
    inner = np.concatenate([[0], *[np.full(len(x), x.shape[1]) for x in found]]).cumsum()
    outer = np.concatenate([[0], [0 if x is None else len(x) for x in rows]]).cumsum()
    absent = np.array([*[x is None for x in rows], False])
    return pa.ListArray.from_arrays(pa.array(outer, pa.int32(), mask=absent if absent.any() else None), pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(flat)))


def map_exams(df: DataFrame, carried: list[str], f: Callable[..., list[tuple]], added: str, args: list[str] | None = None, kind: str = "float", name: str = "tracing") -> DataFrame:
    """Rows for what f(matrix, *args) gives: tuples of the added int columns and a matrix, which becomes column `name`.

    An exam whose leads are of different lengths gives no row; reject_reason names it.
    """
    extra, args = [x.split()[0] for x in added.split(", ")] if added else [], args or []
    rows = df.select(*carried, *[F.col(a).alias(f"__{a}") for a in args], F.col("tracing").alias("__tracing"))
    schema = StructType([df.select(*carried).schema[c] for c in carried])
    for x in extra:
        schema = schema.add(x, IntegerType())
    schema = schema.add(name, ArrayType(ArrayType(FloatType() if kind == "float" else DoubleType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = zip(*[b.column(len(carried) + k).to_pylist() for k in range(len(args))], strict=True) if args else ((),) * b.num_rows
            of, numbers, found, size = [], [], [], 0

            def taken() -> pa.RecordBatch:
                at = pa.array(of, pa.int64())
                columns = [b.column(k).take(at) for k in range(len(carried))]
                columns += [pa.array([n[k] for n in numbers], pa.int32()) for k in range(len(extra))]
                return pa.RecordBatch.from_arrays([*columns, list_column(found, kind)], [*carried, *extra, name])

            for i, (x, v) in enumerate(zip(matrices(b.column(b.num_columns - 1)), values, strict=True)):
                for *n, y in f(x, *v) if x is not None else ():
                    of.append(i)
                    numbers.append(n)
                    found.append(y)
                    size += y.nbytes
                if size > BATCH_BYTES:
                    yield taken()
                    of, numbers, found, size = [], [], [], 0
            yield taken()

    return rows.mapInArrow(run, schema)


def n_samples(tracing: str = "tracing") -> Column:
    return F.size(F.get(F.col(tracing), F.lit(0)))


def with_source_width(df: DataFrame) -> DataFrame:
    """Each row with source_max_t, the longest recording of its source; null is a source too. The arrays stay where they are.

    The lengths come from a column n_samples, if there is one.
    """
    n = F.col("n_samples") if "n_samples" in df.columns else n_samples()
    widths = df.select("source", n.alias("n")).groupBy(F.col("source").alias("__source")).agg(F.max("n").alias("source_max_t"))
    first = widths.limit(BROADCAST_SOURCES + 1).collect()  # short rows, of a number that is checked
    if len(first) <= BROADCAST_SOURCES:
        widths = F.broadcast(df.sparkSession.createDataFrame(first, widths.schema))
    else:
        widths = durable(widths, "widths")
    return df.join(widths, df["source"].eqNullSafe(F.col("__source")), "left").drop("__source")


def to_lead_major(df: DataFrame, col: str = "tracing") -> DataFrame:
    """array of samples by lead -> array of leads by sample, as float."""
    leads = F.sequence(F.lit(0), F.size(F.element_at(F.col(col), 1)) - 1)
    turned = F.transform(leads, lambda c: F.transform(F.col(col), lambda r: r[c].cast("float")))
    return df.withColumn(col, F.when(F.size(col) > 0, turned).otherwise(F.array().cast("array<array<float>>")))


#: Why an exam is not as it should be, in the order in which reasons are looked for. All but the last drop the exam.
REASONS = ("undecodable", "missing", "ragged", "nan", "no_rate")


def mark_rejects(df: DataFrame, seen: Observation | None = None) -> DataFrame:
    """df with `why`, one of REASONS or null: a reader's own reason, no tracing, leads of different lengths, a NaN sample, or in
    collection D1 no usable rate (such an exam stays, without samples). With `seen` the rows that pass are counted by reason
    in the pass that reads them; reject_counts has the numbers once that is done.
    """
    t, first = F.col("tracing"), F.size(F.get("tracing", F.lit(0)))
    why = F.when(F.col("reason").isNotNull(), "undecodable") if "reason" in df.columns else F.when(F.lit(False), "")
    why = why.when(t.isNull(), "missing").when(F.exists(t, lambda x: x.isNull() | (F.size(x) != first)), "ragged")
    why = why.when(F.exists(t, lambda x: F.exists(x, F.isnan)), "nan")
    if {"collection", "rate"} <= set(df.columns):
        rate = F.col("rate").cast("double")
        why = why.when((F.col("collection") == "D1") & (rate.isNull() | F.isnan(rate) | (rate < 1)), "no_rate")
    marked = df.withColumn("why", why)
    counts = [F.count(F.lit(1)).alias("exams"), *[F.count_if(F.col("why") == r).alias(r) for r in REASONS]]
    return marked.observe(seen, *counts) if seen is not None else marked


def kept_records(marked: DataFrame) -> DataFrame:
    """mark_rejects' rows without those that a reason drops."""
    return marked.filter(F.col("why").isNull() | (F.col("why") == REASONS[-1])).drop("why")


def rejected_records(df: DataFrame) -> DataFrame:
    """exam_id, source, why, dropped of the exams that have a reason: the side table to what is kept."""
    return mark_rejects(df).filter("why is not null").select("exam_id", "source", "why", (F.col("why") != REASONS[-1]).alias("dropped"))


def reject_counts(seen: Observation) -> dict[str, int]:
    """How many exams there were, and how many by reason, after the action that the rows went through."""
    return {k: int(v) for k, v in seen.get.items()}


def drop_nan_records(signals: DataFrame, meta: DataFrame, seen: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """Exams without a NaN sample (and with samples, of one length in all leads), and their metadata."""
    clean = kept_records(mark_rejects(signals, seen))
    ids = kept_records(mark_rejects(signals)).select("exam_id")  # not counted twice
    return clean, meta.join(ids, "exam_id", "left_semi")


def active_bounds(tracing: str = "tracing", threshold: float = 1e-6) -> tuple[Column, Column]:
    """start and end columns over the arrays of a row."""
    peak = F.aggregate(
        tracing,
        F.array_repeat(F.lit(0.0), n_samples(tracing)),
        lambda acc, lead: F.zip_with(acc, lead, lambda a, x: F.greatest(a, F.abs(x.cast("double")))),
    )
    on = F.filter(F.transform(peak, lambda x, i: F.when(x > threshold, i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_min(on), F.lit(0)), F.coalesce(F.array_max(on) + 1, F.lit(0))


def active_bounds_long(rows: DataFrame, threshold: float = 1e-6) -> DataFrame:
    """exam_id, start_idx, end_idx from (exam_id, lead, t, x)."""
    on = F.when(F.abs("x") > threshold, F.col("t"))
    return rows.groupBy("exam_id").agg(F.coalesce(F.min(on), F.lit(0)).alias("start_idx"), F.coalesce(F.max(on) + 1, F.lit(0)).alias("end_idx"))


def _exams(df: DataFrame) -> DataFrame:
    return df.withColumn("exam_id", F.col("exam_id").cast("string"))


def remove_baseline(df: DataFrame, kind: str = "float") -> DataFrame:
    """exam_id, source, end_idx, tracing (of kind float or double)."""
    def f(x, width):
        y, end = kernels.remove_baseline(x, int(width or 0))
        return [(end, y)]

    return map_exams(with_source_width(_exams(df)), ["exam_id", "source"], f, "end_idx int", ["source_max_t"], kind)


def _usable(rate: float | None) -> bool:
    return rate is not None and rate == rate and int(rate) > 0


def resample(df: DataFrame, fo: int = 400, kind: str = "float") -> DataFrame:
    """exam_id, tracing, from rate to fo; without a usable rate the result is empty. Kernels are kept by worker."""
    def f(x, rate):
        return [(kernels.resample(x, int(rate), fo) if _usable(rate) else x[:, :0],)]

    return map_exams(_exams(df), ["exam_id"], f, "", ["rate"], kind)


def z_norm(df: DataFrame, eps: float = 1e-5, kind: str = "float") -> DataFrame:
    return map_exams(_exams(df), ["exam_id", "source"], lambda x: [(kernels.z_norm(x, eps),)], "", kind=kind)


def z_norm_long(rows: DataFrame, eps: float = 1e-5) -> DataFrame:
    """exam_id, lead, t, z from (exam_id, lead, t, x): windows by exam for the bounds and by lead for the moments."""
    exam = Window.partitionBy("exam_id")
    lead = Window.partitionBy("exam_id", "lead")
    on = F.when(F.abs("x") > eps, F.col("t"))
    r = rows.withColumns({"s": F.min(on).over(exam), "e": F.max(on).over(exam)})
    inside = F.coalesce(F.col("t").between(F.col("s"), F.col("e")), F.lit(False))
    n = F.greatest(F.col("e") - F.col("s") + 1, F.lit(1))
    r = r.withColumn("inside", inside).withColumn("m", F.sum(F.when(inside, F.col("x")).otherwise(0.0)).over(lead) / n)
    r = r.withColumn("v", F.sum(F.when(F.col("inside"), F.col("x") * F.col("x")).otherwise(0.0)).over(lead) / n - F.col("m") ** 2)
    std = F.greatest(F.sqrt(F.greatest(F.col("v"), F.lit(1e-8))), F.lit(eps))
    return r.select("exam_id", "lead", "t", F.when(F.col("inside"), (F.col("x") - F.col("m")) / std).otherwise(0.0).alias("z"))


def length_offset(df: DataFrame) -> DataFrame:
    """df with length and start_offset, of the window above 1e-5."""
    start, end = active_bounds("tracing", 1e-5)
    return df.withColumn("start_offset", start).withColumn("length", end - F.col("start_offset"))


def normalize_signals(df: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Exams that cannot be used dropped, then baseline, resampling (D1), z-norm and bounds in one pass over the arrays.

    Takes exam_id, source, collection, rate, tracing; gives exam_id, source, length, start_offset, tracing. `seen` counts the
    dropped by reason in the same pass, and rejected_records lists them.
    """
    clean = kept_records(mark_rejects(df, seen)).withColumn("rate", F.col("rate").cast("double"))

    def f(x, width, rate, collection):
        y, length, start = kernels.normalize(x, int(width or 0), rate, collection)
        return [(length, start, y)]

    return map_exams(with_source_width(_exams(clean)), ["exam_id", "source"], f, "length int, start_offset int", ["source_max_t", "rate", "collection"])


def trim_pad(df: DataFrame, target: Column | int, tracing: str = "tracing") -> DataFrame:
    """Samples [start_offset, start_offset + length) at the left of target samples, zeros after."""
    target = F.lit(target) if isinstance(target, int) else target
    n = F.least(F.col("length"), target)
    cut = lambda lead: F.concat(F.slice(lead, F.col("start_offset") + 1, n), F.array_repeat(F.lit(0.0).cast("float"), target - n))
    return df.withColumn(tracing, F.transform(tracing, cut))


def center_pad(df: DataFrame, target: int, tracing: str = "tracing") -> DataFrame:
    """The active part in the middle of target samples; longer ones raise."""
    n, t = F.col("length"), F.lit(target)
    before = F.floor((t - n) / 2).cast("int")
    zeros = lambda k: F.array_repeat(F.lit(0.0).cast("float"), k)
    cut = lambda lead: F.concat(zeros(before), F.slice(lead, F.col("start_offset") + 1, n), zeros(t - n - before))
    checked = F.when(n > t, F.raise_error(F.lit(f"the active part is longer than {target}"))).otherwise(F.transform(tracing, cut))
    return df.withColumn(tracing, checked)


def window_size(w: int, mode: str = "together") -> int:
    return int(w * (1000.0 if mode == "together" else 4000.0) / 512.0)


def segment_windows(df: DataFrame, seg: int, tracing: str = "tracing") -> DataFrame:
    """A row for each of the ceil(length / seg) valid windows: exam_id, window, tracing of seg samples, zero-padded."""
    n = F.ceil(F.col("length") / seg).cast("int")

    def cut(k: Column) -> Column:
        part = lambda lead: F.slice(lead, k * seg + 1, F.lit(seg))
        return F.transform(tracing, lambda lead: F.concat(part(lead), F.array_repeat(F.lit(0.0).cast("float"), F.lit(seg) - F.size(part(lead)))))

    windows = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("window"), cut(k).alias("tracing"))))
    return df.select("exam_id", F.explode(windows).alias("x")).select("exam_id", "x.window", "x.tracing")


def trace_coords(windows: DataFrame, h: int = 512, w: int = 512, mode: str = "together", leads: int = 12) -> DataFrame:
    """exam_id, window, lead, xs and ys: polyline points of each lead, integers truncated toward zero."""
    top = 16 if mode == "per_channel" else 1
    peak = F.aggregate("tracing", F.lit(0.0), lambda m, lead: F.greatest(m, F.array_max(F.transform(lead, lambda x: F.abs(x.cast("double"))))))
    rows = windows.withColumn("peak", peak).select("exam_id", "window", "peak", F.posexplode("tracing").alias("lead", "sig"))
    n = F.size("sig")
    xs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i * (F.lit((w - 1) * top) / F.greatest(n - 1, F.lit(1)))).cast("int"))
    if mode == "together":
        offset = (F.lit(h * 0.05) + F.col("lead") * (h * 0.9 / max(leads - 1, 1))).cast("int")
        y = lambda x: F.least(F.greatest((offset - x.cast("double") * (h * 2.7 / 512.0)).cast("int"), F.lit(0)), F.lit(h - 1))
    else:
        scale = F.lit(h * 0.4) / (F.col("peak") + 1e-6)
        y = lambda x: (F.least(F.greatest(F.lit(h / 2.0) - x.cast("double") * scale, F.lit(0.0)), F.lit(h - 1.0)) * 16).cast("int")
    return rows.select("exam_id", "window", "lead", xs.alias("xs"), F.transform("sig", y).alias("ys"))


def log_spectrogram(df: DataFrame, n_fft: int = 128, hop: int = 64, kind: str = "float") -> DataFrame:
    """exam_id, lead, spec: array of frequencies by time."""
    def f(x):
        return list(enumerate(kernels.log_spectrogram(x, n_fft, hop))) if x.size else []

    return map_exams(_exams(df), ["exam_id"], f, "lead int", kind=kind, name="spec")


def chunk_stft(df: DataFrame, n_fft: int = 256, hop: int = 64, chunk: int = 4000, kind: str = "float") -> DataFrame:
    """exam_id, chunk, lead, spec for chunks whose first sample is below length."""
    def f(x, length):
        return [(k, j, s) for k, by in kernels.chunk_stft(x, int(length), n_fft, hop, chunk) for j, s in enumerate(by)]

    return map_exams(_exams(df), ["exam_id"], f, "chunk int, lead int", ["length"], kind, "spec")


def audit_signals(df: DataFrame) -> DataFrame:
    """One row per source: shape, NaN, Inf, underflow, bounds without NaN, overflow, and a status. Rows are reduced first."""
    flat = F.flatten(F.coalesce(F.col("tracing"), F.array().cast("array<array<float>>")))
    num = F.filter(flat, lambda x: ~F.isnan(x))
    inf = float("inf")
    rows = df.select(
        "source",
        F.col("tracing").isNull().alias("missing"), F.size("tracing").alias("leads"), n_samples().alias("samples"),
        F.exists(flat, lambda x: F.isnan(x)).alias("nan"), F.exists(num, lambda x: F.abs(x) == inf).alias("inf"),
        F.exists(num, lambda x: (F.abs(x) > 0) & (F.abs(x) < 6.1e-5)).alias("under"), F.array_min(num).alias("lo"), F.array_max(num).alias("hi"),
    )
    t = rows.groupBy("source").agg(
        F.count("*").alias("n"), F.max("leads").alias("leads"), F.max("samples").alias("samples"), F.min("leads").alias("fewest"),
        F.bool_or("nan").alias("has_nan"), F.bool_or("inf").alias("has_inf"), F.bool_or("under").alias("has_underflow"),
        F.min("lo").cast("double").alias("min_value"), F.max("hi").cast("double").alias("max_value"), F.bool_and("missing").alias("missing"),
    )
    over = F.greatest(F.abs("min_value"), F.abs("max_value")) > 65500
    status = F.when(F.col("missing"), "missing").when((F.coalesce("leads", F.lit(0)) < 1) | (F.coalesce("samples", F.lit(0)) < 1), "zero dimension").when(F.col("fewest") != F.col("leads"), "bad shape")
    status = status.when(F.col("min_value").isNull(), "only NaN").otherwise("ok")
    return t.select("source", "n", "leads", "samples", "has_nan", "has_inf", "has_underflow", "min_value", "max_value", F.coalesce(over, F.lit(False)).alias("has_overflow"), status.alias("status"))


def longest_signal(inventory: DataFrame) -> DataFrame:
    """exam_id, source, rate, length, seconds of the longest; the least exam_id of equals."""
    top = F.max_by(F.struct("exam_id", "source", "rate", "length"), F.struct("length", -F.col("exam_id")))
    return inventory.agg(top.alias("x")).select("x.exam_id", "x.source", "x.rate", "x.length", (F.col("x.length") / 400).alias("seconds"))


def norm_quality(df: DataFrame) -> DataFrame:
    """Per normalised exam: max abs lead mean, least and greatest lead std inside the window, clean padding, valid."""
    inside = F.transform("tracing", lambda lead: F.slice(lead, F.col("start_offset") + 1, F.col("length")))
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.greatest(F.size(xs), F.lit(1))
    std = lambda xs: F.sqrt(F.greatest(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x.cast("double") ** 2) / F.greatest(F.size(xs), F.lit(1)) - mean(xs) ** 2, F.lit(0.0)))
    outside = lambda lead: F.forall(F.transform(lead, lambda x, i: F.when((i < F.col("start_offset")) | (i >= F.col("start_offset") + F.col("length")), F.abs(x)).otherwise(0.0)), lambda v: v <= 1e-5)
    t = df.select("exam_id", inside.alias("part"), F.forall("tracing", outside).alias("padding_clean"))
    t = t.select("exam_id", "padding_clean", F.array_max(F.transform("part", lambda p: F.abs(mean(p)))).alias("max_abs_mean"), F.transform("part", std).alias("stds"))
    t = t.select("exam_id", "max_abs_mean", F.array_min("stds").alias("min_std"), F.array_max("stds").alias("max_std"), "padding_clean")
    return t.withColumn("valid", (F.col("max_abs_mean") < 0.2) & (F.col("min_std") > 0.5) & (F.col("max_std") < 1.5) & F.col("padding_clean"))


#: A linear congruential step, so that noise is the same in any engine.
_STEP, _ADD, _MOD = 1103515245, 12345, 1 << 31


def _uniform(*parts: tuple[Column, int]) -> Column:
    """0 to 1 from whole numbers and their multipliers."""
    h = sum((c.cast("long") * m for c, m in parts), F.lit(7).cast("long")) % _MOD
    for _ in range(3):
        h = (h * _STEP + _ADD) % _MOD
        h = h.bitwiseXOR(F.shiftright(h, 15))
    return (h + 0.5) / _MOD


def synthetic_exams(keys: DataFrame, leads: DataFrame, seconds: float = 2.0, rates: tuple[int, ...] = (1000, 257, 250, 500, 128)) -> DataFrame:
    """One test exam for each key (column `key`) and rate: per lead a sinusoid with offset and noise, seeded by the key.

    leads (lead, amplitude, offset) has how far amplitudes and offsets go to either side; it is one row per lead. Only the
    standard deviation of the noise, a tenth of the amplitude, is not drawn. Keys and rates are dealt to the tasks, which make
    the samples of an exam at once; no sample is shuffled.
    """
    number, few = F.col("key").cast("long"), leads.agg(F.sort_array(F.collect_list(F.struct("lead", "amplitude", "offset"))).alias("leads"))
    rows = keys.select("key", F.explode(F.array(*[F.lit(r) for r in rates])).alias("rate"))
    rows = rows.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "rate")
    rows = rows.crossJoin(F.broadcast(few)).filter(F.size("leads") > 0)  # by one row

    def drawn(lead: Column) -> Column:
        seed = ((number, 7919), (F.col("rate"), 104729), (lead["lead"], 1299709))
        of = lambda n: _uniform(*seed, (F.lit(n), 611953))
        starts = [sum((c.cast("long") * m for c, m in (*seed, (F.lit(n), 32452843))), F.lit(7).cast("long")).alias(f"s{n}") for n in (5, 6)]
        return F.struct(
            *starts, ((2 * of(1) - 1) * lead["amplitude"]).alias("a"), ((2 * of(2) - 1) * lead["offset"]).alias("o"), (0.5 + 2.5 * of(3)).alias("f"), (2 * np.pi * of(4)).alias("p")
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def taken() -> pa.RecordBatch:
            at = pa.array(of, pa.int64())
            return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), list_column(found)], ["exam_id", "rate", "tracing"])

        for b in batches:
            edges, flat = b.column(2).offsets.to_numpy(), b.column(2).values
            starts = np.array([pc.fill_null(flat.field(f"s{n}"), 0).to_numpy() & (_MOD - 1) for n in (5, 6)]).astype(np.uint32)
            a, o, f, p = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in "aofp")
            of, found, size = [], [], 0
            for i, rate in enumerate(b.column(1).to_pylist()):
                k = slice(edges[i], edges[i + 1])
                of.append(i)
                found.append(kernels.sinusoids(starts[:, k], a[k], o[k], f[k], p[k], rate, int(rate * seconds)))
                size += found[-1].nbytes
                if size > TEST_BYTES:
                    yield taken()
                    of, found, size = [], [], 0
            yield taken()

    rows = rows.select(F.concat(F.lit("SYNTH_Fs"), "rate", F.lit("_"), "key").alias("exam_id"), "rate", F.transform("leads", drawn).alias("leads"))
    return rows.mapInArrow(run, "exam_id string, rate int, tracing array<array<float>>")
