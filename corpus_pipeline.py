"""A corpus pipeline of five stages over `documents`.

Quality filter, exact dedup, near dedup, benchmark decontamination, piece
encoding. Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all
but the last return the columns of `documents`, whatever they are, for the rows
that stay. Each result is written as Parquet and read again as the next stage's
docs.

Cases, of every stage: null texts count as empty, and an empty text is a
document like any other; very long texts are read whole; ties go to the smallest
doc_id; rows that share a doc_id (a missing one included) stay together if any
of them is to stay, and in decontamination go together if any of them is to go;
an empty table stays empty; extra columns are kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronosift.llm import decontamination, exact_dedup, near_dedup, pieces, quality
from chronosift.session import stored, table


def _by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of docs with (left_semi) or without (left_anti) one of the ids; a missing id is an id."""
    other = ids.select(F.col("doc_id").alias("__other")).distinct()
    return docs.join(other, F.col("doc_id").eqNullSafe(F.col("__other")), how)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from labelled rows among docs."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest original stays."""
    return _by_id(docs, exact_dedup.dedup(docs).where("kept"), "left_semi")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked near duplicates stays."""
    return _by_id(docs, near_dedup.near_dedup(docs).where("kept"), "left_semi")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _by_id(docs, found.where("contaminated"), "left_anti")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    return pieces.encode_decode(docs, full=False)


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("pieces", encode_pieces),
]

#: Classifier scores and library encodings have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
