"""Text, encoded text, frequency lists and stop words as tables, and tables as such files.

All go through Spark's readers and writers: any store Spark reads will do, and inputs are split where they can be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cdx, ngrams, vocab


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text: a row for each file, by a hash of its path."""
    return spark.read.text(path, wholetext=True).select(F.xxhash64("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text: a row for each line, so that one large file is read by many tasks; ids go up in reading order."""
    return spark.read.text(path, lineSep="\n").select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))


def from_memory(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def encoded(spark: SparkSession, path: str) -> DataFrame:
    """value, ids: the lines of encoded files."""
    return cdx.read(spark.read.text(path, lineSep="\n"))


def frequencies(spark: SparkSession, path: str) -> DataFrame:
    """n, token of `count token` lines; other lines are left out."""
    parts = F.split("value", " ", 2)
    return spark.read.text(path, lineSep="\n").select(F.get(parts, 0).try_cast("long").alias("n"), F.get(parts, 1).alias("token")).where("n is not null and token is not null")


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """word: one a line, syllables joined by spaces where the file has underscores."""
    return spark.read.text(path, lineSep="\n").select(F.replace(F.trim("value"), F.lit("_"), F.lit(" ")).alias("word")).where("word <> ''").distinct()


def without_stop_words(grams: DataFrame, words: DataFrame, gram: str = "gram") -> DataFrame:
    """grams that are no stop words."""
    return grams.join(words.select(F.col("word").alias(gram)), gram, "left_anti")


def write_frequencies(types: DataFrame, path: str, token: str = "token") -> None:
    """`count token` lines, the most frequent first."""
    types.orderBy(F.desc("n"), token).select(F.concat_ws(" ", F.col("n").cast("string"), token)).write.mode("overwrite").text(path)


def write_listing(types: DataFrame, path: str) -> None:
    """Types by length, the longest first, wrapped with two spaces between them; an empty line after each line."""
    one = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("by"), "token")))
    listed = vocab.wrapped(types).groupBy("line").agg(F.array_join(F.transform(one, lambda x: x["token"]), "  ").alias("value"))
    listed.orderBy("line").select(F.concat("value", F.lit("\n"))).write.mode("overwrite").text(path)


def write_with_marks(types: DataFrame, path: str, skip_syllables: bool = False) -> None:
    """Frequencies in two folders, of types with marks or tones and of those without."""
    types = types.where(~F.col("category").isin("syllmark", "syll0m0t")) if skip_syllables else types
    marked = F.col("category").isin("syllmark", "alphmark").alias("have_marktone")
    types.select("n", F.concat_ws(" ", F.col("n").cast("string"), "token").alias("value"), "token", marked).repartitionByRange("have_marktone", F.desc("n"), "token").sortWithinPartitions("have_marktone", F.desc("n"), "token").select("have_marktone", "value").write.mode("overwrite").partitionBy("have_marktone").text(path)


def write_routed(lines_: DataFrame, path: str) -> None:
    """Lines (line, route) in a folder for each route; order within a document is kept."""
    lines_.select("route", F.col("line").alias("value")).write.mode("overwrite").partitionBy("route").text(path)


def write_encoded(tokens: DataFrame, path: str, key: str = "doc_id") -> None:
    rows = cdx.write_lines(tokens, key)
    rows.repartitionByRange(key, "line_no").sortWithinPartitions(key, "line_no").select("value").write.mode("overwrite").text(path)


def write_grams(counts: DataFrame, path: str) -> None:
    """`count gram` lines, the most frequent first."""
    ngrams.listing(counts).write.mode("overwrite").text(path)


def write_buckets(counts: DataFrame, path: str) -> None:
    """Grams (n, gram, n_count) in a folder for each length and bucket of counts."""
    counts.withColumn("bucket", ngrams.bucket(F.col("n_count"))).write.mode("append").partitionBy("n", "bucket").parquet(path)
