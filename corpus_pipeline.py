"""A training corpus from documents: language, exact copies, near copies, benchmark passages, then the mix.

Defined results
- Null texts go in the first stage; empty ones too. Very long texts are read whole by every stage.
- Rows that repeat both doc_id and text come back once from the copies' stages; rows that share an id alone are told apart by text.
- All stages but the last return all columns of their input, whatever their names; equal inputs give equal outputs.
- An empty table gives empty stages.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulseforge.llm import decontaminate, exact_dedup, language_id, mixing, simhash
from pulseforge.llm.common import discard, durable, scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are of no learned language, or only by a weak score, go; null texts are among them."""
    return language_id.keep_known_language(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for A-Z case the largest doc_id stays; nulls count as empty."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose five-word shingles link them at a Jaccard similarity of 0.8 or more the smallest doc_id stays."""
    return simhash.keep_one_of_each(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a paraphrase of one, go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as written: one row per draw, texts of the last pass cut at a word, shards shuffled locally.

    Rows that repeat are each drawn; doc_id, text, lang and source are carried, and columns beside those of documents are not.
    """
    return mixing.written_mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", drop_unknown_language),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_passages),
    ("mix sources", mix_sources),
]

#: SQL expresses neither the classifier, the fingerprints nor the latent search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order. What a stage wrote for itself is removed once its result, and the next one's, is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            docs = durable(stage(spark, docs, sf_dir), "stage_" + name.replace(" ", "_"))
            kept.append(docs)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
