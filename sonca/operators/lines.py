"""Line statistics and routing by how Vietnamese a line is; no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from ..schemas import AFTER, ESCAPED
from . import scan
from .tokens import core, lines


def stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no, line_bytes, vi_bytes, n_tokens. Tokens of over 255 bytes count nowhere.

    A token is Vietnamese if it has marks and at most 20 bytes (the surface variant; syllables come from the parser).
    """
    return scan.line_figures(docs, key, text)


def route(found: DataFrame) -> DataFrame:
    """Adds route: no_vi under a fifth of Vietnamese bytes, low_vi under half, else main; empty lines are main."""
    line, vi = F.col("line_bytes"), F.col("vi_bytes")
    return found.withColumn("route", F.when(line * 20 > vi * 100, "no_vi").when(line * 50 > vi * 100, "low_vi").otherwise("main"))


def rebuilt(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no, line: each line from its tokens, a space after those that had one."""
    shown = lambda p: let(core(p), lambda c: F.concat(F.when(c == ESCAPED, F.lit("\\n")).otherwise(c), F.when(p.endswith(AFTER) | (c == ESCAPED), " ").otherwise("")))
    return lines(docs, key, text).select(key, "line_no", F.rtrim(F.array_join(F.transform("pieces", shown), "")).alias("line"))
