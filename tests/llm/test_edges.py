"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulseforge.llm import decontaminate, exact_dedup, fill_middle, importance, language_id, line_dedup, mixing, pii, quality, queries, simhash, substring_dedup, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["digest", "h", "range", "size", "fp", "kept", "keep_id", "to", "doc", "spans", "score", "held_out", "found", "label", "ids", "words", "rank", "host", "path", "batch", "shard", "copy", "s", "e", "n", "form", "frames", "units", "chars", "marked", "output", "key", "bytes", "weight", "t", "n_words", "n_features", "buckets"]
LONG = "Lorem ipsum dolor sit amet, consectetur adipiscing elit. " * 20000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "a", 1),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (None, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", None, 1),
    (5, "the QUICK brown fox jumps over the lazy dog and runs away from it.", None, "b", 1),
    (5, "the QUICK brown fox jumps over the lazy dog and runs away from it.", None, "b", 1),
    (6, LONG, "la", "b", 1),
    (7, "1234 !!", None, "b", 1),
    (8, "x" * 150000, None, "c", 1),
    (9, "\n\n \t\r\n", "en", "c", 1),
    (5, "Another text altogether, under an id that two other rows have as well, and long enough to be compared.", "en", "b", 1),
    (None, "A second text without an id, which is no copy of the first one and must not be taken for it anywhere.", None, None, 1),
    (None, "A third text without an id. " * 40, "en", None, 1),
    (10, "甲乙丙丁" * 60 + "。\n" + "甲乙丙丁" * 60 + "。", "zh", "c", 1),
]
BENCH = [(1, "What does the quick brown fox jump over before it runs away"), (2, None), (None, "nothing at all here to find"), (3, "")]


def docs(spark, rows=ROWS):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


OPS = {
    "quality": lambda d, b, lab: quality.classify(d, lab),
    "substring": lambda d, b, lab: substring_dedup.substring_digest(d),
    "mix": lambda d, b, lab: mixing.mix_digest(d),
    "line": lambda d, b, lab: line_dedup.line_digest(d),
    "exact": lambda d, b, lab: exact_dedup.exact_digest(d),
    "language": lambda d, b, lab: language_id.language_digest(d),
    "simhash": lambda d, b, lab: simhash.simhash_digest(d),
    "decontaminate": lambda d, b, lab: decontaminate.decontamination_report(d, b),
    "pii": lambda d, b, lab: pii.pii_digest(d),
    "fim": lambda d, b, lab: fill_middle.fim_digest(d),
    "bpe": lambda d, b, lab: queries.byte_bpe.bpe_digest(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    "importance": lambda d, b, lab: importance.resampling_digest(d, b),
    "mask": lambda d, b, lab: pii.mask_pii(d),
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_operators(spark, name):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    lab = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (7, None, None), (None, 1, 1)], "doc_id long, quality long, toxic long")
    rows = OPS[name](docs(spark), bench, lab).collect()
    once = len({r[:2] for r in ROWS})
    assert len(rows) == (once if name == "exact" else len(ROWS))
    assert sorted((r.doc_id for r in rows), key=repr)[-1] is None
    assert OPS[name](docs(spark, []), bench, lab).count() == 0
    assert OPS[name](docs(spark), bench.limit(0), lab.limit(0)).count() == len(rows)


def test_results_on_the_edges(spark):
    d = docs(spark)
    exact = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_digest(d).collect()}
    assert sum(r.kept for r in exact.values()) == len({(r[1] or "").lower() for r in ROWS})
    fox = next(r for r in exact.values() if r.doc_id == 5)
    assert (fox.keep_id, fox.group_size, fox.kept) == (5, 4, True)
    fp = {r.doc_id: r for r in simhash.simhash_digest(d).collect()}
    assert fp[2].fingerprint == fp[3].fingerprint == fp[9].fingerprint == "0" * 16 and fp[9].component_id == 2
    found = {(r.doc_id, r.component_id) for r in simhash.simhash_digest(d).collect()}
    assert (None, 1) in found and (None, None) in found  # a copy of document 1, and texts that have no id among their copies
    lang = {r.doc_id: r for r in language_id.language_digest(d).collect()}
    assert all(lang[k].lang_pred == "und" and lang[k].score == 0 for k in (2, 3, 7, 9))
    sub = {r.doc_id: r for r in substring_dedup.substring_digest(d).collect()}
    assert sub[8].n_removed == 150000 - 100 + 99 or sub[8].n_removed == 149999
    assert sub[2].n_bytes == 0 and sub[6].n_spans == 1


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages(spark, sf, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    d = docs(spark).drop("label")
    for c in ("lang_pred", "label", "__key", "__digest", "__lang_pred", "__score", "__text", "t"):
        d = d.withColumn(c, F.lit("clash"))
    out = f(spark, d, sf)
    rows = out.collect()
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == d.columns
        assert rows and all(r[c] == "clash" for r in rows for c in d.columns[5:])
    f(spark, d.limit(0), sf).collect()


def test_pages(spark):
    big = "<p>" + "é" * 200
    rows = [(3, "http://a/b c\r\n", big), (1, None, big), (2, "u", None), (4, "u", "x"), (5, "v", "x"), (None, "n", big), (3, "http://a/b c\r\n", big), (9, "z", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("first", F.lit("clash"))
    got = sorted(warc.read_archives(warc.write_archives(pages)).collect(), key=repr)
    assert len(got) == len(rows)
    of = {r.page_id: r for r in got}
    assert of[1].record_type == "response" and of[3].refers_to == of[None].refers_to == 1 and of[3].record_type == "revisit"
    assert of[3].payload_bytes == 403 and of[3].payload_digest == of[1].payload_digest and of[9].payload_bytes == 3_000_000
    assert of[4].record_type == of[5].record_type == "response"
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
