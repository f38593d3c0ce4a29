"""Vocabulary tables: counts of types, totals, listings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scan
from .tokens import category


def types(tokens: DataFrame, where: Column | None = None) -> DataFrame:
    """token, category, n; counts are combined before the shuffle."""
    rows = tokens if where is None else tokens.where(where)
    return rows.groupBy("token", "category").agg(F.count(F.lit(1)).alias("n"))


def types_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """token, category, n of whole texts, counted where they are read."""
    return scan.token_counts(docs, text).select("token", category(F.col("token")).alias("category"), "n")


def alphabet_types(tokens: DataFrame) -> DataFrame:
    return types(tokens, F.col("category") != "nonalpha")


def nonalpha_types(tokens: DataFrame) -> DataFrame:
    """With the newline as a type of its own."""
    return types(tokens, F.col("category") == "nonalpha")


def totals(tokens: DataFrame) -> DataFrame:
    """category, n_tokens, n_one_byte: by category."""
    return tokens.groupBy("category").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum((F.octet_length("token") == 1).cast("long")).alias("n_one_byte"))


def by_count(found: DataFrame, most: int | None = None) -> DataFrame:
    """The most frequent types first; ties in order of the token."""
    found = found.orderBy(F.desc("n"), "token")
    return found.limit(most) if most else found


def by_length(found: DataFrame, most: int | None = None) -> DataFrame:
    """The longest types (in bytes) first."""
    found = found.withColumn("bytes", F.octet_length("token")).orderBy(F.desc("bytes"), "token")
    return found.limit(most) if most else found


def with_marks(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The types with marks or tones, and those without."""
    marked = F.col("category").isin("syllmark", "alphmark")
    return found.where(marked), found.where(~marked)


#: Bytes between two types of a listing, and those that a line stays under.
PAD, WIDTH = 2, 80


def line_starts(lengths: list[tuple[int, int]], width: int = WIDTH) -> list[tuple[int, int, int, int]]:
    """(bytes, line, fit, per) by length from (bytes, types) with the longest first, as lines are filled one type after the
    other: `fit` types of a length still go to the line begun, the others fill the next ones with `per` each."""
    out, line, used = [], 0, 0
    for size, n in lengths:
        per = max(1, (width - 1 - size) // (size + PAD) + 1)
        fit = 0 if used + size >= width and used else max(1 if not used else 0, (width - 1 - size - used) // (size + PAD) + 1)
        out.append((size, line, fit, per))
        if n <= fit:
            used += n * (size + PAD)
        else:
            more = n - fit
            line += -(-more // per)
            used = ((more - 1) % per + 1) * (size + PAD)
    return out


def wrapped(found: DataFrame, width: int = WIDTH) -> DataFrame:
    """token, bytes, line: a listing by length, the longest first, wrapped greedily: a type goes to the line begun if the
    line stays under `width` bytes, with two spaces between types.

    Lines follow from the rank of a type in its length. Ranks are found within short prefixes of types and moved on by
    what stands before, so that no task has to sort a whole length. Only the counts by length come together in one task.
    """
    rows = found.select("token", F.octet_length("token").alias("bytes"), F.substring("token", 1, 3).alias("prefix"))
    counts = rows.groupBy("bytes", "prefix").agg(F.count(F.lit(1)).alias("types"))
    before = counts.select("bytes", "prefix", (F.sum("types").over(Window.partitionBy("bytes").orderBy("prefix")) - F.col("types")).alias("before"))
    def starts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = sorted((x for b in stream for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), reverse=True)
        names, rows = ("bytes", "first", "fit", "per"), line_starts(lengths, width)
        yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.int32() if n == "bytes" else pa.int64()) for i, n in enumerate(names)})

    lengths = counts.groupBy("bytes").agg(F.sum("types").alias("types")).coalesce(1)  # a row for each length that occurs
    starts = lengths.mapInArrow(starts, "bytes int, first long, fit long, per long")
    ranked = rows.withColumn("own", F.row_number().over(Window.partitionBy("bytes", "prefix").orderBy("token")) - 1).join(before, ["bytes", "prefix"]).join(F.broadcast(starts), "bytes")
    rank = F.col("before") + F.col("own")
    line = F.when(rank < F.col("fit"), F.col("first")).otherwise(F.col("first") + 1 + F.floor((rank - F.col("fit")) / F.col("per")))
    return ranked.select("token", "bytes", line.cast("long").alias("line"))
