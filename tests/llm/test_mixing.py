"""The splitting tree's draws against the hypergeometric distribution, and the mix through the tree."""

from math import comb

import pytest
from pyspark.sql import functions as F

from pulseforge.llm import mixing


def drawn(spark, marked, rest, slots, n):
    c = [F.lit(x).cast("long") for x in (marked, rest, slots)]
    rows = spark.range(n).select(mixing._draw(*c, F.col("id"), F.lit("a"), 3).alias("x")).groupBy("x").count().collect()
    return {r.x: r["count"] for r in rows}


@pytest.mark.parametrize("marked,rest,slots", [(40, 100, 30), (3, 500, 250), (7, 9, 8), (0, 5, 2), (5, 5, 2), (4, 4, 4)])
def test_draws_are_hypergeometric(spark, marked, rest, slots):
    n, got = 4000, drawn(spark, marked, rest, slots, 4000)
    want = {k: comb(marked, k) * comb(rest - marked, slots - k) / comb(rest, slots) for k in range(max(0, slots - rest + marked), min(marked, slots) + 1)}
    assert set(got) <= set(want)
    chance = sum((got.get(k, 0) - n * p) ** 2 / (n * p) for k, p in want.items() if n * p >= 5)
    assert chance < 2.5 * len(want) + 12


def test_large_draws_have_the_right_spread(spark):
    marked, rest, slots = 3_000_000_000, 9_000_000_000, 4_000_000_000
    got = drawn(spark, marked, rest, slots, 2000)
    mean = sum(k * n for k, n in got.items()) / 2000
    var = sum((k - mean) ** 2 * n for k, n in got.items()) / 2000
    p = marked / rest
    want = slots * p * (1 - p) * (rest - slots) / (rest - 1)
    assert abs(mean - slots * p) < 5 * (want / 2000) ** 0.5 and 0.8 < var / want < 1.2


def test_too_many_sources_are_refused(spark):
    many = spark.range(mixing.MOST_SOURCES + 1).select(F.col("id").cast("string").alias("source"), F.lit(1).alias("quota"))
    with pytest.raises(Exception, match="more than 4096 sources"):
        mixing.splitting_tree(many, 1).collect()


def test_what_is_taken_is_what_the_shards_hold(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    plan = mixing.mix_digest(d, 4).groupBy().sum("taken", "n_draws").first()
    mix = mixing.mixed_rows(d, 4).groupBy().agg(F.sum("words").alias("w"), F.count("*").alias("n"), F.countDistinct("shard").alias("shards")).first()
    assert (plan[0], plan[1], 4) == (mix.w, mix.n, mix.shards)
