"""The driver's tables in the shapes that the operators take."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TYPES = ["view", "signup", "error", "click", "purchase"]
K = len(TYPES)
WEIGHTS = [[1.0 if i == j else 0.5 - abs(i - j) * 0.05 for j in range(K)] for i in range(K)]
THRESHOLDS = [0.30 + 0.05 * k for k in range(K)]
NSR = 0
RATES = [1000, 500, 257, 250, 128]
LEAVES = 32


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exam_id, lead, t, x: two leads of each user's events in time order; errors are zeros, so heads and tails are flat."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value", "props")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    quiet = F.col("event_type") == "error"
    x0 = F.when(quiet, 0.0).otherwise(F.col("value"))
    x1 = F.when(quiet, 0.0).otherwise(F.get_json_object("props", "$.k").cast("double"))
    rows = e.select(F.col("user_id").alias("exam_id"), (F.row_number().over(order) - 1).alias("t"), x0.alias("x0"), x1.alias("x1"))
    leads = F.array(F.struct(F.lit(0).alias("lead"), F.col("x0").alias("x")), F.struct(F.lit(1).alias("lead"), F.col("x1").alias("x")))
    return rows.select("exam_id", "t", F.explode(leads).alias("l")).select("exam_id", "l.lead", "t", "l.x")


def array_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exam_id, source, rate, collection, tracing: the same signals as arrays, one row per exam."""
    e = read(spark, sf_dir, "events")
    quiet = F.col("event_type") == "error"
    x = F.struct("ts", "event_id", F.when(quiet, 0.0).otherwise(F.col("value")).alias("x0"), F.when(quiet, 0.0).otherwise(F.get_json_object("props", "$.k").cast("double")).alias("x1"))
    rows = e.groupBy("user_id").agg(F.sort_array(F.collect_list(x)).alias("xs"))
    lead = lambda c: F.transform("xs", lambda v: v[c].cast("float"))
    k = F.col("user_id") % 5
    return rows.select(
        F.col("user_id").cast("string").alias("exam_id"), k.cast("string").alias("source"), F.element_at(F.array(*[F.lit(r) for r in RATES]), (k + 1).cast("int")).alias("rate"),
        F.when(k == 4, "D2").otherwise("D1").alias("collection"), F.array(lead("x0"), lead("x1")).alias("tracing"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exam_id, source, tracing: the embeddings as 4 leads of 16 samples; every 17th has a NaN."""
    v = read(spark, sf_dir, "embeddings")
    e = F.transform("embedding", lambda x: x.cast("float"))
    e = F.when(F.col("vec_id") % 17 == 0, F.transform(e, lambda x, i: F.when(i == 5, float("nan")).otherwise(x).cast("float"))).otherwise(e)
    v = v.select(F.col("vec_id").cast("string").alias("exam_id"), F.col("label").cast("string").alias("source"), e.alias("e"))
    return v.select("exam_id", "source", F.array(*[F.slice("e", 16 * k + 1, 16) for k in range(4)]).alias("tracing"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, labels, probs from the events; integers underneath, so that every engine gets the same doubles."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type")
    is_type = lambda k: F.col("event_type") == TYPES[k]
    label = [is_type(k) | ((F.col("event_id") * 7 + k) % 11 == 0) for k in range(K)]
    prob = [((F.col("event_id") * 7919 + k * 104729) % 1000 + F.when(is_type(k), 400).otherwise(0)).cast("double") / 1400.0 for k in range(K)]
    return e.select(F.col("event_id").alias("rec_id"), F.array(*label).alias("labels"), F.array(*prob).alias("probs"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exam_id, patient_id, source, length, from orders and their lines."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("exam_id"), F.col("o_custkey").alias("patient_id"), F.col("o_orderpriority").alias("source"))
    n = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("exam_id")).agg(F.sum("l_quantity").alias("q"))
    return o.join(n, "exam_id", "left").select("exam_id", "patient_id", "source", F.coalesce("q", F.lit(0)).cast("int").alias("length"))


def order_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exam_id, patient_id, source, tracing: an order's lines as samples of two leads; every third begins with a flat one."""
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("exam_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = line.groupBy("exam_id").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("xs"))
    flat = lambda i: (i == 0) & (F.col("exam_id") % 3 == 0)
    lead = lambda f: F.transform("xs", lambda v, i: F.when(flat(i), 0.0).otherwise(f(v)).cast("float"))
    both = F.array(lead(lambda v: v["l_quantity"]), lead(lambda v: (v["l_suppkey"] % 100).cast("double")))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("exam_id"), F.col("o_custkey").alias("patient_id"), F.col("o_orderpriority").alias("source"))
    return o.join(rows.select("exam_id", both.alias("tracing")), "exam_id")


def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, quality and toxic as text, source_classes: sources with an odd number lack toxic."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    x = read(spark, sf_dir, "labels").join(d, "doc_id")
    forms = F.array(F.lit("True"), F.lit(" \ttrue\t\n"), F.lit("1"))
    text = lambda c: F.when(F.col(c) == 1, F.element_at(forms, (F.col("doc_id") % 3 + 1).cast("int"))).otherwise("False")
    odd = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int") % 2 == 1
    has = F.when(F.coalesce(odd, F.lit(False)), F.array(F.lit("quality"))).otherwise(F.array(F.lit("quality"), F.lit("toxic")))
    return x.select("doc_id", "source", text("quality").alias("quality"), text("toxic").alias("toxic"), has.alias("source_classes"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exam_id, codes: three diagnosis codes for each order, one in eight unknown."""
    from ..functions.labels import CODES

    every = F.array(*[F.lit(c) for c in CODES], F.lit("0"), F.lit("1"), F.lit("2"), F.lit("3"))
    key = F.col("o_orderkey")
    pick = [F.element_at(every, ((key * m + a) % (len(CODES) + 4) + 1).cast("int")) for m, a in ((7, 0), (11, 3), (13, 8))]
    return read(spark, sf_dir, "orders").select(key.alias("exam_id"), F.array(*pick).alias("codes"))


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, name, key, value: a run for each customer nation, its metrics from the accounts."""
    c = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("s"))
    mean = F.floor(F.col("s") / F.col("n")) / 100
    of = {"stabilité/macro_f1_mean": mean, "stabilité/macro_f1_ci_lower": F.col("lo"), "stabilité/macro_f1_ci_upper": F.col("hi"), "stabilité/hamming_loss_mean": F.col("hi"), "AUPRC": F.col("lo"),
          "test_metrics/challenge_score": F.col("n").cast("double"), "performance/temps_inference_sec": F.col("hi"), "performance/rate": F.col("n").cast("double"), "binaire_malade/f1_score": mean, "binaire_malade/loss": F.col("lo")}
    cells = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in of.items()])
    return c.select(F.concat(F.lit("run"), F.col("c_nationkey")).alias("run_id"), F.concat(F.lit("model"), F.col("c_nationkey") % 3).alias("name"), F.explode(cells).alias("x")).select("run_id", "name", "x.key", "x.value")
