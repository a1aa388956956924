"""A query for every operator, over the driver's tables as bindings shapes them."""

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, scores
from ..operators import inventory as inv
from ..operators import metrics, report, scoring, signals
from ..shared import durable, new_path
from ..sources import normalized, recordings, shards, tables
from . import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(name: str) -> Column:
    return F.round(F.col(name).cast("double"), 6).alias(name)


def in_doubles(x: Column, digits: int) -> Column:
    """x rounded by a product of doubles, halves away from 0, as the SQL's engine does; F.round makes a decimal number of each x."""
    return F.signum(x) * (F.floor(F.abs(x) * 10.0**digits + 0.5) / 10.0**digits)


def samples(df: DataFrame, *keys: str) -> DataFrame:
    """A row for each sample: keys, lead, t, x."""
    return df.select(*keys, F.posexplode("tracing").alias("lead", "xs")).select(*keys, "lead", F.posexplode("xs").alias("t", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    """samples by four digits, where another engine's sums may round otherwise."""
    return df.select(*keys, F.posexplode("tracing").alias("lead", "xs")).select(*keys, "lead", F.posexplode("xs").alias("t", "x")).withColumn("x", F.round("x", 4))


def decided(s: SparkSession, d: str) -> DataFrame:
    return metrics.with_decisions(b.predictions(s, d), b.THRESHOLDS)


# -- sources and sinks ---------------------------------------------------------------------------------------------


@query
def S1_source_pairs(s, d):
    o = b.read(s, d, "orders").select(F.col("o_orderkey").alias("k"))
    # a name is there once in every folder
    path = lambda end: F.concat(F.lit("set/g"), F.col("k") % 7, F.lit("/E."), F.floor(F.col("k") / 7), F.lit(end)).alias("path")
    return tables.source_pairs(o.select(path(".dat")), o.filter("k % 3 <> 0").select(path(".csv")))


@query
def S2_read_metadata(s, d):
    x = b.label_table(s, d)
    root = new_path(s, "metadata")
    even = F.array_contains("source_classes", "toxic")
    quality, toxic, key = F.col("quality").alias(" quality"), F.col("toxic").alias("toxic "), F.col("doc_id")
    # one folder, four headers: three orders of the same columns, one after a mark and blank lines, and one without toxic
    cell = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    lines = x.filter(even & (key % 4 == 2)).groupBy((key % 64).alias("f")).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(",", cell("toxic"), key, cell("quality")))), "\r\n").alias("lines"))
    content = F.encode(F.concat(F.lit("\ufeff\n , ,\ntoxic ,\tdoc_id, quality\r\n"), "lines", F.lit("\n\n")), "UTF-8")
    recordings.write_files(lines.select(F.concat(F.lit("late/f+"), "f", F.lit(" .csv")).alias("path"), content.alias("content")), root)
    x.filter(even & (key % 4 == 0)).select("doc_id", quality, toxic, F.lit("").alias("nn_predicted_age")).write.mode("append").csv(root, header=True)
    x.filter(even & (key % 2 == 1)).select(toxic, quality, "doc_id").write.mode("append").csv(root, header=True)
    x.filter(~even).select("doc_id", "quality").write.mode("append").csv(root, header=True)
    m = tables.read_metadata(s, [root], ["quality", "toxic"])
    return m.select(F.col("doc_id").cast("long").alias("doc_id"), labels.strip(F.col("quality")).alias("quality"), labels.strip(F.col("toxic")).alias("toxic"), F.size("source_classes").cast("long").alias("n_classes"))


@query
def S3_read_headers(s, d):
    c = b.read(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    rate = F.when(F.col("k") % 4 == 0, F.concat(F.lit("E 2 bad 100\nlead 16 "), F.col("k"))).otherwise(F.concat(F.lit("E 2 "), F.col("k") % 500 + 100, F.lit(" 100")))
    sex = F.when(F.col("k") % 3 == 0, "").when(F.col("k") % 3 == 1, "# Sex:\tMale \t\n").otherwise("# Sex: f\n")
    value = F.concat(rate, F.lit("\n# Age: "), F.when(F.col("k") % 5 == 0, F.lit("n/a")).otherwise((F.col("k") % 90).cast("string")), F.lit("\n"), sex, F.lit("\t# Dx:\t1, \t"), F.col("k") % 7, F.lit("\t\r\n"))
    path = F.concat(F.lit("data/ds"), F.col("c_nationkey"), F.lit("/g1/E"), F.col("k"), F.lit(".hea"))
    root = new_path(s, "headers")
    recordings.write_files(c.select(path.alias("path"), F.encode(value, "UTF-8").alias("content")), root)
    found = recordings.read_headers(s, root)
    return found.withColumns({"codes": F.array_join("codes", ","), "path": F.regexp_extract("path", "/data/ds.*", 0)})


def _hex(v: Column, bits: int) -> Column:
    """v's lowest bits as lower-endian hexadecimal bytes."""
    return F.concat(*[F.lpad(F.hex(F.pmod(F.shiftright(v, 8 * i), F.lit(256))), 2, "0") for i in range(bits // 8)])


def recording_files(s: SparkSession, d: str) -> DataFrame:
    """path, content: two exams of each name, in folders g0 and g1, of five kinds by c_custkey % 5: format 16; 16 at an offset, with
    gain 0 and an ADC zero; 212; 16 with a missing sample; 16 and 61 in a file each. Every 50th names a file that is not there.
    """
    c = b.read(s, d, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    c = c.select("k", F.concat(F.lit("E"), F.floor(F.col("k") / 2)).alias("e"), (F.col("k") % 5).alias("kind"))
    v = lambda i: F.pmod(F.col("k") * 31 + i * 97, F.lit(2000)) - 1000
    eight = lambda f: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), f), "")
    plain = eight(lambda i: _hex(v(i), 16))
    holed = eight(lambda i: F.when(i == 3, F.lit("0080")).otherwise(_hex(v(i), 16)))
    low = lambda i: F.pmod(v(i), F.lit(4096))
    pair = lambda i: _hex(low(2 * i) % 256 + (F.floor(low(2 * i) / 256) + F.floor(low(2 * i + 1) / 256) * 16) * 256 + (low(2 * i + 1) % 256) * 65536, 24)
    twelve = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), pair), "")
    one = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: _hex(v(2 * i), 16)), "")
    big = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.substring(_hex(v(2 * i + 1), 16), 3, 2), F.substring(_hex(v(2 * i + 1), 16), 1, 2))), "")
    ending = F.when(F.col("kind") == 1, ".mat").otherwise(".dat")
    lead = lambda name, said: F.concat(F.col("e"), name, F.lit(f" {said}\n"))
    of = F.when(F.col("kind") == 0, F.concat(lead(ending, "16 200/mV 16 0 0 0 0 I"), lead(ending, "16 100(-5)/mV 16 0 0 0 0 II")))
    of = of.when(F.col("kind") == 1, F.concat(lead(ending, "16+24 0/mV 16 1024 0 0 0 I"), lead(ending, "16+24 1000/mV")))
    of = of.when(F.col("kind") == 2, F.concat(lead(ending, "212 200 11 0 0 0 0 I"), lead(ending, "212 50(7)/mV 11 0 0 0 0 II")))
    of = of.when(F.col("kind") == 3, F.concat(lead(ending, "16 200/mV"), lead(ending, "16 200/mV")))
    of = of.otherwise(F.concat(lead(F.lit("_a.dat"), "16 200/mV"), lead(F.lit("_b.dat"), "61 100/mV")))
    path = lambda end: F.concat(F.lit("set/g"), F.col("k") % 2, F.lit("/"), F.col("e"), end)
    file = lambda end, content: F.struct(path(end).alias("path"), F.unhex(content).alias("content"))
    body = F.when(F.col("kind") == 1, F.concat(F.repeat(F.lit("AB"), 24), plain)).when(F.col("kind") == 2, twelve).when(F.col("kind") == 3, holed).otherwise(plain)
    data = F.when(F.col("k") % 50 == 7, F.array().cast("array<struct<path:string,content:binary>>"))
    data = data.when(F.col("kind") == 4, F.array(file(F.lit("_a.dat"), one), file(F.lit("_b.dat"), big))).otherwise(F.array(file(ending, body)))
    head = F.concat(F.lit("\n# a comment\n"), F.col("e"), F.lit(" 2 500 4\n"), of, F.lit("# Age: 1\n"))
    heads = c.select(path(F.lit(".hea")).alias("path"), F.encode(head, "UTF-8").alias("content"))
    return heads.union(c.select(F.explode(data).alias("x")).select("x.path", "x.content"))


@query
def S4_read_recordings(s, d):
    root = new_path(s, "recordings")
    recordings.write_files(recording_files(s, d), root)
    found = recordings.read_recordings(s, root)
    rows = found.select("folder", "exam_id", "reason", F.explode_outer(F.transform("tracing", lambda xs, i: F.struct(i.alias("lead"), xs.alias("xs")))).alias("x"))
    rows = rows.select("folder", "exam_id", "reason", "x.lead", F.posexplode_outer("x.xs").alias("t", "x"))
    return rows.withColumn("x", F.round(F.nanvl(F.col("x").cast("double"), F.lit(None).cast("double")), 6))


@query
def S5_to_lead_major(s, d):
    v = b.read(s, d, "embeddings")
    rows = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.slice("embedding", t * 4 + 1, F.lit(4)))
    return samples(signals.to_lead_major(v.select("vec_id", rows.alias("tracing"))), "vec_id")


@query
def S6_write_normalized(s, d):
    path, x = new_path(s, "normalized"), b.array_signal(s, d)
    normalized.write_normalized(x.withColumn("rate", F.lit(0)), path)
    normalized.write_normalized(x.filter("source <> '3'"), path)  # all but one again, and that one in a run of its own
    normalized.write_normalized(x.filter("source = '3'"), path)
    normalized.write_run(x.withColumn("rate", F.lit(1)), path)  # cut short: it has no note
    total = F.aggregate(F.get("tracing", F.lit(0)), F.lit(0.0), lambda a, v: a + v)
    return normalized.read_normalized(s, path).select("exam_id", "source", "rate", signals.n_samples().alias("samples"), F.round(total, 4).alias("total"))


@query
def S7_split_by_source(s, d):
    path = new_path(s, "by_source")
    tables.split_by_source(b.read(s, d, "documents").select("doc_id", F.concat(F.lit(" "), "source", F.lit(" ")).alias("source")), "source", path)
    return s.read.csv(path, header=True).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"))


def shard_plan(s: SparkSession, d: str, exams: DataFrame) -> DataFrame:
    """The exams' slim rows with split, pos and shard_id, label vector, and where their signal lies."""
    slim = durable(signals.length_offset(exams).select("exam_id", "patient_id", "source", "length", "start_offset"), "inventory")
    plan = inv.assign_shards(inv.length_buckets(durable(inv.patient_split(slim), "split"), 256), 1000)
    named = b.codes(s, d).select("exam_id", F.transform(labels.derive_labels(F.col("codes")), lambda y: y.cast("float")).alias("labels"))
    return plan.join(named, "exam_id").drop("block")


@query
def S8_write_shards(s, d):
    exams, buckets, path = b.order_signals(s, d), int(s.conf.get("spark.sql.shuffle.partitions")), new_path(s, "shards")
    stored = shards.store_signals(exams, new_path(s, "signals"), buckets)
    shards.write_shards(shard_plan(s, d, exams), stored, buckets, path)
    names = F.array_join(F.filter(F.transform("labels", lambda y, i: F.when(y == 1, F.element_at(F.array(*[F.lit(c) for c in labels.CLASSES]), i + 1))), lambda c: c.isNotNull()), ",")
    back = s.read.parquet(path).select("exam_id", "split", F.col("shard_id").cast("long").alias("shard_id"), "pos", "patient_id", "source", "start_offset", "length", "width", names.alias("labels"), "tracing")
    return samples(back, *back.columns[:-1])


@query
def S9_read_weight_matrix(s, d):
    from pyspark.sql import Window

    e = b.read(s, d, "events").select("user_id", "event_type", "ts", "event_id")
    e = e.withColumn("before", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("before is not null")
    path = new_path(s, "weights")
    wide = e.groupBy("before").pivot("event_type", b.TYPES).count()
    # a row for each type, written with blanks and tabs around names and numbers
    lines = wide.select(F.concat_ws(" ,\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in wide.columns]).alias("line"))
    head = " , ".join(["", *[f" {c}" for c in b.TYPES]]) + "\n"
    content = F.encode(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list("line")), "\n")), "UTF-8")
    recordings.write_files(lines.agg(F.lit("w.csv").alias("path"), content.alias("content")), path)
    return tables.read_weight_matrix(s, path).select("class_i", "class_j", F.when(F.isnan("w"), 0.0).otherwise(F.col("w")).alias("w"))


@query
def S10_write_json_map(s, d):
    path = new_path(s, "json")
    w = labels.class_weights(b.label_table(s, d), ["quality", "toxic"])
    tables.write_json_map(w, F.col("class"), F.col("pos_weight"), path)
    return s.read.text(path).select(F.explode(F.from_json("value", "map<string,double>")).alias("class", "pos_weight"))


# -- scalars -------------------------------------------------------------------------------------------------------


@query
def P1_normalize_id(s, d):
    x = b.read(s, d, "documents").select("doc_id", F.encode(F.concat(F.lit(" "), F.col("source")), "UTF-8").alias("raw"), F.concat(F.lit(" \t"), "source", F.lit("\r\n ")).alias("text"))
    return x.select(labels.normalize_id(x, "doc_id").alias("id"), labels.normalize_id(x, "raw").alias("raw"), labels.normalize_id(x, "text").alias("text"))


@query
def P2_derive_labels(s, d):
    x = b.codes(s, d).select("exam_id", F.posexplode(labels.derive_labels(F.col("codes"))).alias("i", "y"))
    return x.filter("y").select("exam_id", F.element_at(F.array(*[F.lit(c) for c in labels.CLASSES]), F.col("i") + 1).alias("class"))


@query
def P3_conform_labels(s, d):
    x = b.read(s, d, "labels").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("quality") + 0.75).alias("quality"), "toxic")
    return labels.conform_labels(x, ["quality", "toxic", "absent"]).select("doc_id", *[F.col(c).cast("double").alias(c) for c in ("quality", "toxic", "absent")])


@query
def P4_parse_true(s, d):
    return b.label_table(s, d).select("doc_id", labels.parse_true(F.col("quality")).cast("long").alias("quality"), labels.parse_true(F.col("toxic")).cast("long").alias("toxic"))


@query
def P5_drop_nan_records(s, d):
    v = b.vectors(s, d)
    return signals.drop_nan_records(v, v.select("exam_id", "source"))[1]


def _flawed(s, d) -> DataFrame:
    """The vectors, some with a NaN, some with a shorter lead, some missing, and a rate that some lack."""
    v = b.vectors(s, d).withColumns({"n": F.col("exam_id").cast("long"), "collection": F.when(F.col("exam_id").cast("long") % 2 == 0, "D1").otherwise("D2")})
    short = F.transform("tracing", lambda x, i: F.when(i == 2, F.slice(x, 1, 9)).otherwise(x))
    t = F.when(F.col("n") % 23 != 0, F.when(F.col("n") % 19 == 0, short).otherwise(F.col("tracing")))
    return v.withColumns({"tracing": t, "rate": F.when(F.col("n") % 13 != 0, 400.0)}).drop("n")


@query
def P5_rejected_records(s, d):
    return signals.rejected_records(_flawed(s, d))


@query
def P5_reject_counts(s, d):
    seen = Observation()
    signals.normalize_signals(_flawed(s, d), seen).write.format("noop").mode("overwrite").save()
    return s.createDataFrame(list(signals.reject_counts(seen).items()), "what string, n long")


@query
def P6_sigmoid_probs(s, d):
    e = b.read(s, d, "events").select("event_id", F.array(*[((F.col("event_id") * 7919 + k * 104729) % 1000).cast("double") / 100.0 - 5.0 for k in range(b.K)]).alias("logits"))
    probs, finite = scores.sigmoid_probs(F.col("logits"))
    return e.select("event_id", finite.alias("finite"), F.posexplode(probs).alias("class_idx", "prob")).withColumn("prob", F.round("prob", 6))


@query
def P7_impute_probs(s, d):
    odd = F.element_at(F.array(*[F.lit(float(x)) for x in ("nan", "inf", "-inf", "0.25")]), (F.col("event_id") % 4 + 1).cast("int"))
    e = b.read(s, d, "events").select("event_id", scores.impute_probs(F.array(odd, F.lit(0.5))).alias("p"))
    return e.select("event_id", F.element_at("p", 1).alias("p0"), F.element_at("p", 2).alias("p1"))


@query
def P8_apply_thresholds(s, d):
    return metrics.cells(decided(s, d)).select("rec_id", "class_idx", "decided")


@query
def P9_valid_mask(s, d):
    m = b.inventory(s, d).select("exam_id", scores.valid_mask(F.col("length"), 60).alias("mask"))
    return m.select("exam_id", F.size("mask").cast("long").alias("width"), F.aggregate("mask", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("valid"), F.element_at("mask", 1).cast("double").alias("first"))


@query
def P10_rename_normal(s, d):
    x = b.read(s, d, "labels").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "D2").otherwise("D1").alias("collection"), F.col("quality").alias("normal_ecg"), F.col("toxic").alias("NSR"))
    return labels.rename_normal(x)


# -- signals -------------------------------------------------------------------------------------------------------


@query
def G1_active_bounds(s, d):
    start, end = signals.active_bounds()
    return b.array_signal(s, d).select(F.col("exam_id").cast("long").alias("exam_id"), start.alias("start_idx"), end.alias("end_idx"))


@query
def G1_active_bounds_long(s, d):
    return signals.active_bounds_long(b.long_signal(s, d))


@query
def G2_remove_baseline(s, d):
    return samples(signals.remove_baseline(b.array_signal(s, d), "double"), "exam_id", "end_idx")


@query
def G3_resample(s, d):
    return rounded(signals.resample(b.array_signal(s, d), kind="double"), "exam_id")


@query
def G4_z_norm(s, d):
    return samples(signals.z_norm(b.array_signal(s, d), kind="double"), "exam_id")


@query
def G4_z_norm_long(s, d):
    x = b.long_signal(s, d).withColumn("x", F.col("x").cast("float").cast("double"))
    return signals.z_norm_long(x).select(F.col("exam_id").cast("string").alias("exam_id"), "lead", "t", F.round("z", 6).alias("x"))


@query
def G5_length_offset(s, d):
    return signals.length_offset(b.array_signal(s, d)).select("exam_id", "length", "start_offset")


@query
def G6_trim_pad(s, d):
    return samples(signals.trim_pad(signals.length_offset(b.array_signal(s, d)), 100), "exam_id")


@query
def G7_center_pad(s, d):
    return samples(signals.center_pad(signals.length_offset(b.array_signal(s, d)), 400), "exam_id")


@query
def G8_segment_windows(s, d):
    return samples(signals.segment_windows(signals.length_offset(b.array_signal(s, d)), 25), "exam_id", "window")


def _points(s, d, mode):
    w = signals.trace_coords(signals.segment_windows(signals.length_offset(b.array_signal(s, d)), 25), 512, 512, mode, 2)
    return w.select("exam_id", "window", "lead", F.posexplode(F.arrays_zip("xs", "ys")).alias("t", "p")).select("exam_id", "window", "lead", "t", F.col("p.xs").alias("px"), F.col("p.ys").alias("py"))


@query
def G9_trace_coords(s, d):
    return _points(s, d, "together")


@query
def G9_trace_coords_per_channel(s, d):
    return _points(s, d, "per_channel")


def _bins(spec: DataFrame, *keys: str) -> DataFrame:
    x = spec.select(*keys, F.posexplode("spec").alias("freq", "xs"))
    return x.select(*keys, "freq", F.posexplode("xs").alias("frame", "x")).withColumn("x", F.round(F.col("x"), 4))


@query
def G10_log_spectrogram(s, d):
    return _bins(signals.log_spectrogram(signals.resample(b.array_signal(s, d), kind="double"), kind="double"), "exam_id", "lead")


@query
def G11_chunk_stft(s, d):
    """A row for each frequency: what its 63 frames add up to, alone and by frame, and the greatest."""
    spec = signals.chunk_stft(signals.length_offset(b.array_signal(s, d)), kind="double")
    x = spec.select("exam_id", "chunk", "lead", F.posexplode("spec").alias("freq", "xs"))
    total = lambda f: F.aggregate(F.transform("xs", f), F.lit(0.0), lambda a, v: a + v)
    return x.select("exam_id", "chunk", "lead", "freq", F.size("xs").alias("frames"), F.round(total(lambda v, i: v), 3).alias("total"), F.round(total(lambda v, i: v * i) / 63, 3).alias("by_frame"), F.round(F.array_max("xs"), 4).alias("greatest"))


@query
def normalize_signals(s, d):
    """The whole of 3.1 after decoding: one pass over the arrays."""
    x = signals.normalize_signals(b.array_signal(s, d))
    return x.select("exam_id", "source", "length", "start_offset", F.transform("tracing", lambda t: F.size(t)).alias("sizes")).withColumn("sizes", F.array_join("sizes", ","))


# -- joins ---------------------------------------------------------------------------------------------------------


def _index(s, d) -> DataFrame:
    o = b.read(s, d, "orders").select(F.col("o_orderkey").alias("exam_id"))
    twice = o.filter("exam_id % 10 = 0")
    return o.filter("exam_id % 7 <> 0").withColumn("h5_path_src", F.lit("a")).union(twice.withColumn("h5_path_src", F.lit("b"))).withColumn("h5_idx_src", F.col("exam_id") * 2)


@query
def J1_build_inventory(s, d):
    return inv.build_inventory(b.inventory(s, d).withColumn("trace_file", F.lit("old")).withColumn("h5_path_src", F.lit("old")), _index(s, d))


@query
def J2_align_metadata(s, d):
    return inv.align_metadata(_index(s, d).select("exam_id", "h5_path_src"), b.inventory(s, d).filter("exam_id % 4 <> 0"))


@query
def J3_keep_matching(s, d):
    return inv.keep_matching(b.inventory(s, d), _index(s, d))


# -- aggregations --------------------------------------------------------------------------------------------------


@query
def A1_class_weights(s, d):
    return labels.class_weights(b.label_table(s, d), ["quality", "toxic"])


@query
def A2_audit_signals(s, d):
    return signals.audit_signals(b.vectors(s, d)).withColumns({"min_value": F.round("min_value", 6), "max_value": F.round("max_value", 6)})


@query
def A3_longest_signal(s, d):
    return signals.longest_signal(b.inventory(s, d).withColumn("rate", F.element_at(F.array(*[F.lit(r) for r in b.RATES]), (F.col("exam_id") % 5 + 1).cast("int"))))


@query
def A4_confusion_per_class(s, d):
    return metrics.confusion_per_class(decided(s, d))


@query
def A4_confusion_normalized(s, d):
    return metrics.confusion_per_class(decided(s, d), normalize=True).select("class_idx", *[r6(c) for c in ("tp", "fp", "fn", "tn")])


@query
def A5_f_measure(s, d):
    return metrics.f_measure(decided(s, d)).select("class_idx", r6("f1"))


@query
def A6_exact_match(s, d):
    return metrics.exact_match(decided(s, d)).select(r6("exact_match"))


@query
def A7_hamming_loss(s, d):
    return metrics.hamming_loss(decided(s, d)).select(r6("hamming_loss"))


@query
def A8_brier(s, d):
    return metrics.brier(b.predictions(s, d)).select("class_idx", r6("brier"))


@query
def A9_mcc(s, d):
    return metrics.mcc(decided(s, d)).select(r6("mcc"))


@query
def A10_binary_sick(s, d):
    return metrics.binary_sick(decided(s, d), b.NSR).select("tp", "fp", "fn", "tn", *[r6(c) for c in ("sensitivity", "specificity", "f1", "mcc", "prevalence")])


@query
def A11_roc_pr_auc(s, d):
    return metrics.roc_pr_auc(b.predictions(s, d)).select("class_idx", r6("auroc"), r6("auprc"))


@query
def A12_pair_confusion(s, d):
    return metrics.pair_confusion(decided(s, d)).select("class_i", "class_j", r6("a"))


@query
def A13_challenge_score(s, d):
    return metrics.challenge_score(decided(s, d), b.WEIGHTS, b.NSR).select(r6("challenge_score"))


@query
def A14_bootstrap_ci(s, d):
    return metrics.bootstrap_ci(decided(s, d), b.WEIGHTS, b.NSR, leaves=b.LEAVES).select("metric", r6("mean"), r6("lower"), r6("upper"))


@query
def A14_bootstrap_poisson(s, d):
    return metrics.bootstrap_ci(decided(s, d), b.WEIGHTS, b.NSR, poisson=True).select("metric", r6("mean"), r6("lower"), r6("upper"))


@query
def A15_per_class_report(s, d):
    return metrics.per_class_report(decided(s, d)).select("class_idx", *[r6(c) for c in ("f1", "recall", "specificity", "auroc", "auprc", "brier")])


@query
def A16_evaluation_summary(s, d):
    by = {"challenge": b.THRESHOLDS, "f1": [0.4] * b.K, "mcc": [0.5] * b.K}
    x = metrics.evaluation_summary(b.predictions(s, d), by, b.WEIGHTS, b.NSR)
    return x.select(*[r6(c) for c in x.columns])


@query
def A17_norm_quality(s, d):
    x = signals.norm_quality(signals.length_offset(signals.z_norm(b.array_signal(s, d), kind="double")))
    return x.select("exam_id", *[F.round(c, 5).alias(c) for c in ("max_abs_mean", "min_std", "max_std")], "padding_clean", "valid")


@query
def A18_macro_ap(s, d):
    return metrics.macro_ap(b.predictions(s, d)).select(r6("macro_ap"))


# -- ordering and sampling -----------------------------------------------------------------------------------------


def split_inventory(s: SparkSession, d: str) -> DataFrame:
    return inv.patient_split(b.inventory(s, d))


def sharded(s: SparkSession, d: str) -> DataFrame:
    return inv.assign_shards(inv.length_buckets(durable(split_inventory(s, d), "split"), 256), 1000)


@query
def W1_patient_split(s, d):
    return split_inventory(s, d).select("exam_id", "patient_id", "split")


@query
def W2_assign_patient_ids(s, d):
    c = b.read(s, d, "customer").select(F.concat(F.lit("ds"), F.col("c_nationkey") % 4).alias("dataset"), F.concat(F.lit("p/"), F.md5(F.col("c_name"))).alias("path"))
    return inv.assign_patient_ids(c)


@query
def W3_length_buckets(s, d):
    return inv.length_buckets(durable(split_inventory(s, d), "split"), 256).select("exam_id", "split", "block", "pos")


@query
def W4_assign_shards(s, d):
    return sharded(s, d).select("exam_id", "split", "pos", "shard_id")


@query
def W5_shard_stats(s, d):
    return inv.shard_stats(sharded(s, d))


@query
def W6_batch_plan(s, d):
    return inv.batch_plan(sharded(s, d), 64, 512, True)


@query
def W6_batch_plan_validation(s, d):
    return inv.batch_plan(sharded(s, d), 64, 512, False)


@query
def W7_sample_per_source(s, d):
    return inv.sample_per_source(b.inventory(s, d), 20).select("exam_id", "source", "sample_pos")


@query
def W8_synthetic_exams(s, d):
    lead, v = F.col("event_id") % 12, F.col("value")
    leads = b.read(s, d, "events").groupBy(lead.cast("int").alias("lead")).agg(F.round(F.stddev_pop(v), 6).alias("amplitude"), F.round(F.avg(v), 6).alias("offset"))
    x = signals.synthetic_exams(b.read(s, d, "supplier").select(F.col("s_suppkey").alias("key")), leads)
    x = x.select("exam_id", "rate", F.posexplode("tracing").alias("lead", "xs")).select("exam_id", "rate", "lead", F.explode("xs").alias("x"))
    x = x.withColumn("x", in_doubles(F.col("x").cast("double"), 6)).groupBy("exam_id", "rate", "lead")
    return x.agg(F.count("*").alias("n"), in_doubles(F.avg("x"), 4).alias("mean"), in_doubles(F.max("x"), 3).alias("greatest"))


# -- scoring, tuning, reports --------------------------------------------------------------------------------------


@query
def U1_score_batches(s, d):
    exams = b.array_signal(s, d).withColumn("exam_id", F.col("exam_id").cast("long"))
    slim = durable(signals.length_offset(exams).select("exam_id", F.col("exam_id").alias("patient_id"), "length", "start_offset"), "inventory")
    plan = inv.assign_shards(inv.length_buckets(durable(inv.patient_split(slim), "split"), 256), 1000)
    plan = inv.planned_rows(plan, 16, 128, train=False).withColumn("labels", F.array(*[F.col("exam_id") % 5 == k for k in range(b.K)]))
    # some exams lie in the plan whose tracing is missing or empty
    t = F.when(F.col("exam_id") % 31 == 3, F.lit(None)).when(F.col("exam_id") % 31 == 7, F.array().cast("array<array<float>>")).otherwise(F.col("tracing"))

    def load():
        def model(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
            """Mean and greatest of the first lead, mean of the second, and how much of the batch's width the exam fills; in doubles."""
            valid = mask.sum(axis=1, dtype=np.float64)
            mean = (x * mask[:, None]).sum(axis=2, dtype=np.float64) / valid[:, None]
            greatest = x[:, 0].max(axis=1).astype(np.float64)
            return np.stack([mean[:, 0] / 50 - 1, greatest / 100, mean[:, 1] / 50, valid / x.shape[2], mean[:, 0] - mean[:, 1]], axis=1)

        return model

    found = scoring.score_batches(plan, exams.withColumn("tracing", t), load)
    return metrics.cells(found.select("rec_id", "labels", "probs")).join(found.select("rec_id", "width"), "rec_id").select("rec_id", "class_idx", "label", r6("prob"), "width")


@query
def U2_tune_thresholds(s, d):
    found = scoring.threshold_table(s, scoring.tune_thresholds(b.predictions(s, d), b.WEIGHTS, b.NSR))
    return found.select("metric", "class_idx", F.round("threshold", 2).alias("threshold"), r6("score"))


@query
def U2_probability_intervals(s, d):
    return scoring.probability_intervals(b.predictions(s, d))


@query
def R1_leaderboard(s, d):
    of = [report.leaderboard(b.run_metrics(s, d), k).withColumn("kind", F.lit(k)) for k in ("bin", "stat", "perf")]
    return of[0].unionByName(of[1]).unionByName(of[2]).select("kind", "run_id", "name", "metric", r6("mean"), r6("lower"), r6("upper"), "best")


@query
def R2_format_metrics(s, d):
    return report.wide(report.leaderboard(b.run_metrics(s, d), "stat"), ["macro_f1", "hamming_loss", "challenge_score", "mean_auprc"])
