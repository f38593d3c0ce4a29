"""The training-data pipeline: five stages over `documents`, each written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonca.llm import decontamination, minhash, packing, quality, substring_dedup
from sonca.llm.common import Scratch, dropped, small_batches, table
from sonca.llm.queries import PACKING, vocabulary

#: Words of a passage that is cut where it repeats.
PASSAGE = 50


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    small_batches(spark)
    return quality.selected(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id."""
    small_batches(spark)
    return minhash.deduplicated(docs)


def substring_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that stand earlier; n_chars follows the text."""
    small_batches(spark)
    return substring_dedup.clean(docs, window=PASSAGE).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark."""
    small_batches(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that are left."""
    small_batches(spark)
    return packing.pack(docs, vocabulary(PACKING))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_deduplication),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        with dropped():  # what a stage has set aside is not read once its result is written
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs


#: Trained models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None
