"""Positional inverted index, and exact removal of repeated lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import AFTER, BEFORE
from .syllables import is_word, sliced
from .tokens import pieces


def document_postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """token, doc_id, at: the positions of each word of each document, gathered where the document is read."""
    schema = pa.schema([("token", pa.string()), (key, pa.int64()), ("at", pa.list_(pa.int32()))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in stream for x in sliced(b)):
            ids, cut = batch.columns
            coded, sizes = cut.flatten().dictionary_encode(), cut.value_lengths().fill_null(0).to_numpy()
            found = [read_word(p) for p in coded.dictionary.to_pylist()]
            names = {w: i for i, w in enumerate(dict.fromkeys(w for w in found if w is not None))}
            code = np.array([-1 if w is None else names[w] for w in found], np.int64)[coded.indices.to_numpy()]
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            kept = code >= 0
            code, row, pos = code[kept], row[kept], pos[kept].astype(np.int32)
            order = np.lexsort((pos, row, code))
            code, row, pos = code[order], row[order], pos[order]
            begin = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])])) if len(code) else np.zeros(0, np.int64)
            at = pa.ListArray.from_arrays(pa.array(np.append(begin, len(code)), pa.int32()), pa.array(pos))
            yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()).take(pa.array(code[begin])), ids.take(pa.array(row[begin])), at], schema=schema)

    return docs.select(F.col(key).cast("long").alias(key), pieces(F.col(text)).alias("p")).mapInArrow(run, f"token string, {key} long, at array<int>")


def read_word(piece: str) -> str | None:
    """The word of a piece, None for other tokens."""
    core = piece.strip(BEFORE + AFTER)
    return core if is_word(core) else None


def gathered(by_doc: DataFrame, key: str = "doc_id", spread: int = 1) -> DataFrame:
    """token, part, n_docs, n_tokens, docs: postings (doc_id, positions) in order of doc_id, from `document_postings`.

    With spread over 1, the postings of a token lie in as many parts, by a hash of the document, so that no token's list
    has to fit in one row or one task.
    """
    part = F.pmod(F.xxhash64(key), F.lit(spread)).cast("int") if spread > 1 else F.lit(0)
    return by_doc.groupBy("token", part.alias("part")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("at")).cast("long").alias("n_tokens"), F.array_sort(F.collect_list(F.struct(F.col(key).alias("doc_id"), "at"))).alias("docs"))


def postings(tokens: DataFrame, key: str = "doc_id", spread: int = 1) -> DataFrame:
    """`gathered` from rows of tokens: positions are gathered by (token, document) first."""
    return gathered(tokens.groupBy("token", key).agg(F.array_sort(F.collect_list("pos")).alias("at")), key, spread)


def phrase(tokens: DataFrame, words: list[str], key: str = "doc_id") -> DataFrame:
    """doc_id, pos of each place where the words follow each other: rare tokens by pushed filter, one aggregation."""
    at = F.lit(None).cast("array<int>")
    for i, w in reversed(list(enumerate(words))):
        at = F.when(F.col("token") == w, F.array(*[F.lit(j) for j, x in enumerate(words) if x == w])).otherwise(at)
    rows = tokens.where(F.col("token").isin(*words)).select(key, F.explode(F.transform(at, lambda i: F.col("pos") - i)).alias("pos"))
    return rows.groupBy(key, "pos").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(words)).select(key, "pos")


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no, line of non-empty lines."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "line")).where("line <> ''")


def first_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", by: Column | None = None) -> DataFrame:
    """line, doc_id, line_no, n: each distinct line where it stands first, and how often it stands at all.

    The shuffle holds one row for each line and task: minimum and count are combined before it.
    """
    rows = lines_of(docs, key, text)
    found = rows.groupBy((by if by is not None else F.col("line")).alias("line")).agg(F.min(F.struct(F.col(key).alias("doc_id"), "line_no")).alias("at"), F.count(F.lit(1)).alias("n"))
    return found.select("line", "at.doc_id", "at.line_no", "n")
