"""From raw documents to packed training sequences: language, quality, exact and near copies, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; each result is written as Parquet and read again.
All stages but the last return the columns of ``docs``, whatever their names; extra columns stay.

Null and empty texts have no language that could be accepted and go in the first stage. Null languages and sources say nothing. Of rows that repeat a
text, whatever their ids, the smallest id stays (a null id is the largest; of equal ids, one row). An empty table gives no rows in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import language, near_dedup, packing, perplexity, quotient_dedup
from shelfwise.llm.cells import free_name
from shelfwise.sources.staging import stage


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; empty ones and such without letters go."""
    mark = free_name(docs, "judged")
    return language.with_language(docs, into=mark).filter(F.col(f"{mark}.accepted")).select(*docs.columns)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band."""
    mark = free_name(docs, "judged")
    return perplexity.with_quality(docs, into=mark).filter(F.col(f"{mark}.kept")).select(*docs.columns)


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the smallest id."""
    return quotient_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarities of five-word windows of 0.8 or more connect."""
    return near_dedup.drop_near_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identified),
    ("quality_rules", of_quality),
    ("exact_dedup", without_exact_copies),
    ("near_dedup", without_near_copies),
    ("best_fit_packing", packed),
]

#: Perplexities and packing are no SQL; the tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; between them, the rows lie in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
