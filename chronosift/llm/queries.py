"""The corpus operators as queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronosift.llm import decontamination, exact_dedup, filter_audit, lm, near_dedup, phrases, pieces, quality, secrets, suffix_dedup, token_counts, token_files, warc
from chronosift.session import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_docs(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(_docs(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_docs(spark, sf_dir))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_docs(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_docs(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_docs(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_docs(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_docs(spark, sf_dir)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(_docs(spark, sf_dir), full=False)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_docs(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_docs(spark, sf_dir), table(spark, sf_dir, "labels"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES = (
    op1_quality, op2_lm_scores, op3_suffix_dedup, op4_near_dedup, op5_decontamination, op6_secrets, op7_token_counts, op8_exact_dedup, op9_token_files, op10_pieces,
    op11_collocations, op12_filter_audit, op13_warc,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_secrets": secrets.OP6_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL,
        "op11_collocations": phrases.OP11_SQL, "op12_filter_audit": filter_audit.OP12_SQL, "op13_warc": warc.OP13_SQL,
    }
