"""Different texts under a null or a repeated doc_id are rows of their own in every stage."""

import random

import pytest

import corpus_pipeline
from pulseforge.llm import decontaminate, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(12)
    text = lambda k: " ".join(f"word{k}n{rng.randrange(10**6)}" for _ in range(30))
    return [(i, text(k), "en", "a", 1) for k, i in enumerate([None] * 5 + [7] * 5 + [1, 2, 3])]


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES if s not in ("language ID", "benchmark decontamination")])
def test_stages_keep_every_text(spark, sf, stage):
    d = spark.createDataFrame(rows(), SCHEMA)
    out = dict(corpus_pipeline.STAGES)[stage](spark, d, sf).collect()
    assert {(r.doc_id, r.text) for r in out} >= {r[:2] for r in rows()}


def test_draws_of_rows_without_an_id_and_of_equal_rows(spark):
    all_rows = rows() + rows()[:1] + rows()[5:6]
    d = spark.createDataFrame(all_rows, SCHEMA)
    plan, mix = mixing.plan_mix(d, 4).collect(), mixing.mixed_rows(d, 4).collect()
    assert sorted(x.words for r in plan for x in r.draws) == sorted(r.words for r in mix)
    assert sorted(mix, key=repr) == sorted(mixing.mixed_rows(d.repartition(3), 4).collect(), key=repr)


def test_one_contaminated_text_takes_no_other_with_it(spark):
    d = spark.createDataFrame(rows(), SCHEMA)
    bench = spark.createDataFrame([(1, rows()[2][1]), (2, rows()[6][1])], "item_id long, text string")
    kept = {(r.doc_id, r.text) for r in decontaminate.drop_contaminated(d, bench).collect()}
    assert kept == {r[:2] for k, r in enumerate(rows()) if k not in (2, 6)}


def test_a_near_copy_goes_though_its_id_stays_elsewhere(spark, sf):
    first, other = rows()[10], rows()[11]
    d = spark.createDataFrame([(1, *first[1:]), (7, *other[1:]), (7, first[1].replace(" ", "  ", 1), "en", "a", 1), (None, first[1] + " ", "en", "a", 1), (None, rows()[0][1], "en", "a", 1)], SCHEMA)
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, d, sf).collect()), key=repr)
    assert kept == sorted([(1, first[1]), (7, other[1]), (None, rows()[0][1])], key=repr)
