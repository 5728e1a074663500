"""A training corpus from raw documents in stages; each stage's rows are written and read again by the next.

Quality rules drop documents that fail the base rules or a fitted cutoff, language identification drops those
without letters or whose words' languages are unsure, the n-gram join leaves one document of each group of near copies, and packing puts what is
left into sequences. Every stage works on all rows that the stage before has kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimlab.llm import common, cost_packing, language_crf, ngram_join, quality_rules


# Executors hold shuffled texts of the stage before when packing begins, so its workers remember less.
PACKING_MEMORY = 60_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs keep."""
    return quality_rules.kept_documents(docs, common.table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words have sure languages, mixed or not; the model is learned from these documents' own labels."""
    common.small_batches(spark)
    return language_crf.surely_labelled(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by five-word shingles at 80 percent."""
    common.small_batches(spark)
    return ngram_join.one_of_each_group(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document in sequences of 2048 tokens."""
    common.small_batches(spark)
    return cost_packing.pack_documents(docs, memory=PACKING_MEMORY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("language", language),
    ("near_copies", near_copies),
    ("packing", packing),
]

# Fitted models and vocabularies decide what stays, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = common.new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
