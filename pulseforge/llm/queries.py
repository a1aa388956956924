"""The operators' queries over the driver's tables, and the SQL that checks those which SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, exact_dedup, fill_middle, importance, language_id, line_dedup, mixing, pii, quality, simhash, substring_dedup, warc
from .common import table
from .oracles import ORACLES


def _docs(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


def _warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": lambda spark, sf_dir: quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op2_substring_dedup": _docs(substring_dedup.substring_digest),
    "op3_source_mix": _docs(mixing.mix_digest),
    "op4_line_dedup": _docs(line_dedup.line_digest),
    "op5_exact_dedup": _docs(exact_dedup.exact_digest),
    "op6_language_id": _docs(language_id.language_digest),
    "op7_simhash": _docs(simhash.simhash_digest),
    "op8_decontaminate": lambda spark, sf_dir: decontaminate.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op9_pii": _docs(pii.pii_digest),
    "op10_warc": _warc,
    "op11_fill_middle": _docs(fill_middle.fim_digest),
    "op12_byte_bpe": _bpe,
    "op13_importance": lambda spark, sf_dir: importance.resampling_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
