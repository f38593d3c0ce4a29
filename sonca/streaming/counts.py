"""The operators over streams: what is stateless runs as it is, counts keep one row of state for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lines, syllables, tokens


def documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files_a_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def vocabulary(docs: DataFrame) -> DataFrame:
    """token, category, n so far: for the update or complete mode."""
    return tokens.tokenize(docs).groupBy("token", "category").agg(F.count(F.lit(1)).alias("n"))


def windowed_vocabulary(docs: DataFrame, at: str = "at", window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """start, token, category, n of each span of time, for the append mode.

    Documents up to `late` behind the newest count in their span; a span is given out once none can come, and its state goes.
    """
    rows = tokens.tokenize(docs.withWatermark(at, late), key=at)
    return rows.groupBy(F.window(at, window).alias("w"), "token", "category").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "token", "category", "n")


def syllable_vocabulary(docs: DataFrame) -> DataFrame:
    """syllable_id, n so far; state is bounded by the id space."""
    return syllables.document_ids(docs).select(F.explode("ids").alias("syllable_id")).where("syllable_id <> 32767").groupBy("syllable_id").agg(F.count(F.lit(1)).alias("n"))


def routed(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line_bytes, vi_bytes, n_tokens, route: stateless, for the append mode."""
    return lines.route(lines.stats(docs))
