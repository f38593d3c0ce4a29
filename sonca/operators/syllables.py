"""From tokens to syllables: parsing in Arrow batches, and vocabularies of syllables.

A batch's tokens are dictionary-encoded and each distinct one is parsed once, with a bounded memo for a whole process;
nothing is shuffled or broadcast. Vocabularies parse the types that are left after counting.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from ..functions import ids
from ..functions.columns import let
from ..functions.syllable import can_be_vietnamese, lookup, may_parse
from ..functions.telex import MAX_LEN
from ..schemas import AFTER, ALPHA, BEFORE, ESCAPED, NONE_ID
from .tokens import lines, pieces

#: A type and not its text, which could only be read in a session.
PARSED = StructType([StructField("syllable_id", IntegerType()), *[StructField(x, BooleanType()) for x in ("marked", "first_upper", "all_upper")]])
MODES = ("dense", "spare", "parts", "utf8")


@F.pandas_udf(PARSED)
def _parsed(tokens: pd.Series) -> pd.DataFrame:
    codes, types = pd.factorize(tokens)
    none = (None, False, False, False)
    found = [lookup(t) if may_parse(t) else none for t in types] + [none]
    columns = list(zip(*found, strict=True))
    at = np.where(codes < 0, len(types), codes)
    return pd.DataFrame({"syllable_id": pd.array(columns[0], "Int32")[at], **{k: np.array(v, bool)[at] for k, v in zip(("marked", "first_upper", "all_upper"), columns[1:], strict=True)}})


@F.pandas_udf(BooleanType())
def _vietnamese(tokens: pd.Series) -> pd.Series:
    codes, types = pd.factorize(tokens)
    return pd.Series(np.array([*map(can_be_vietnamese, types), False], bool)[codes])


def candidate(token: Column, category: Column) -> Column:
    """What may be a syllable: letters, at most MAX_LEN bytes."""
    return (category != "nonalpha") & (F.octet_length(token) <= MAX_LEN)


def with_syllables(rows: DataFrame, token: str = "token") -> DataFrame:
    """rows (token, category, ...) with syllable_id, marked, first_upper, all_upper; and the category a syllable has.

    Only candidates reach Python; the rest passes as null.
    """
    p = rows.withColumn("p", _parsed(F.when(candidate(F.col(token), F.col("category")), F.col(token))))
    s = p["p"]["syllable_id"]
    category = F.when(s.isNull(), F.col("category")).when(p["p"]["marked"], "syllmark").otherwise("syll0m0t")
    return p.withColumn("category", category).select(*rows.columns, "p.*")


def vietnamese(rows: DataFrame, token: str = "token") -> DataFrame:
    """rows with can_be_vietnamese: also true for ASCII Telex."""
    return rows.withColumn("can_be_vietnamese", F.coalesce(_vietnamese(F.col(token)), F.lit(False)))


def transform(syllable_id: Column, first_upper: Column, all_upper: Column, mode: str = "dense") -> Column:
    """A syllable's rendering, with carets for case in the dense and spare modes."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    s = ids.decode(syllable_id)
    out = {"dense": lambda x: ids.dense(x), "spare": lambda x: ids.dense(x, spare=True), "parts": ids.parts, "utf8": ids.utf8}[mode]
    shown = let(s, out)
    if mode in ("parts", "utf8"):
        return shown
    gap = " " if mode == "spare" else ""
    caret = F.when(~first_upper, "").when(all_upper, f"^^{gap}").otherwise(f"^{gap}")
    return F.when(syllable_id.isNotNull(), F.concat(caret, shown))


def syllable_types(types: DataFrame, mode: str = "dense") -> DataFrame:
    """vocab, n: counts by rendering from counts by token (token, category, n)."""
    found = with_syllables(types).where("syllable_id is not null")
    by_id = found.groupBy("syllable_id", "first_upper", "all_upper").agg(F.sum("n").alias("n"))
    return by_id.groupBy(transform(F.col("syllable_id"), F.col("first_upper"), F.col("all_upper"), mode).alias("vocab")).agg(F.sum("n").alias("n"))


def lower_types(syllables: DataFrame) -> DataFrame:
    """vocab, n without case."""
    return syllables.groupBy(ids.without_case(F.col("vocab")).alias("vocab")).agg(F.sum("n").alias("n"))


def bare_types(syllables: DataFrame) -> DataFrame:
    """vocab, n without case, tone and mark."""
    return syllables.groupBy(ids.without_tone_and_mark(F.col("vocab")).alias("vocab")).agg(F.sum("n").alias("n"))


def rime_types(syllables: DataFrame) -> DataFrame:
    """vocab, n from the first vowel on."""
    lower = ids.without_case(F.col("vocab"))
    return syllables.groupBy(F.regexp_replace(lower, "^[^aeyuio]+", "").alias("vocab")).agg(F.sum("n").alias("n"))


#: Whether a token's first character is a letter, and so all of them.
is_word = re.compile(f"[{ALPHA}]").match


class Piece(NamedTuple):
    """What a piece of a cut text is: a token, whether it is fenced, and the syllable that it spells."""

    token: str
    fenced: int
    category: str
    syllable_id: int | None
    first_upper: bool
    all_upper: bool


def read_piece(piece: str) -> Piece:
    core = piece.strip(BEFORE + AFTER)
    fenced = 3 if core in ("\n", ESCAPED) else 2 * piece.startswith(BEFORE) + piece.endswith(AFTER)
    category = "nonalpha" if not is_word(core) else "alph0m0t" if core.isascii() else "alphmark"
    i, marked, first, every = (None, False, False, False) if category == "nonalpha" else lookup(core)
    if i is not None:
        category = "syllmark" if marked else "syll0m0t"
    return Piece("\\n" if core == ESCAPED else core, fenced, category, i, first, every)


#: Pieces of texts that a worker works on at once, if a single text has no more.
PIECES = 1 << 18


def sliced(batch: pa.RecordBatch, most: int = PIECES) -> Iterator[pa.RecordBatch]:
    """A batch whose last column are lists, in slices of about `most` elements, so that what is made of them stays small."""
    ends = np.cumsum(batch.column(batch.num_columns - 1).value_lengths().fill_null(0).to_numpy().astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), batch.num_rows]
    for first, last in zip(cuts, cuts[1:]):
        if last > first:
            yield batch.slice(first, last - first)


def piecewise(rows: DataFrame, keys: str, columns: str, of: Callable[[list[str]], Callable[[np.ndarray, np.ndarray], list]]) -> DataFrame:
    """rows (keys, pieces) with columns from their pieces. `of` reads the distinct pieces of a batch, each once, and
    returns what makes the columns out of each piece's number and of where each row's pieces begin."""
    names = [x.split(" ")[0] for x in f"{keys}, {columns}".split(", ")]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in stream for x in sliced(b)):
            pieces = batch.column(batch.num_columns - 1)
            coded = pieces.flatten().dictionary_encode()
            starts = np.concatenate([[0], np.cumsum(pieces.value_lengths().fill_null(0).to_numpy())])
            made = of(coded.dictionary.to_pylist())(coded.indices.to_numpy(), starts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=names)

    return rows.mapInArrow(run, f"{keys}, {columns}")


def document_ids(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids: a syllable id, or NONE_ID, for each token of a document in order; no shuffle."""

    def of(distinct: list[str]):
        ids = np.array([NONE_ID if (i := read_piece(p).syllable_id) is None else i for p in distinct], np.int32)
        return lambda codes, starts: [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids[codes], pa.int32()))]

    return piecewise(docs.select(F.col(key).cast("long").alias("doc_id"), pieces(F.col(text)).alias("pieces")), "doc_id long", "ids array<int>", of)


def joined(texts: list[str], codes: np.ndarray, starts: np.ndarray) -> pa.Array:
    """For each row, its pieces' texts one after the other."""
    flat = pa.array(texts, pa.string()).take(pa.array(codes)) if len(texts) else pa.array([], pa.string())
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), flat), "")


def rendered_lines(docs: DataFrame, mode: str = "dense", key: str = "doc_id", text: str = "text", keep_origin: bool = True) -> DataFrame:
    """doc_id, line_no, line, line_bytes, vi_bytes, n_tokens, n_syllables: lines with syllables rendered.

    Bytes count what is written; a Vietnamese token counts with the space after it. Without keep_origin a syllable
    stands between two delimiter bytes (in the dense mode). Tokens of over 255 bytes are written and count nowhere.
    A line is made where it is read: nothing is shuffled, and the renderings of the id space are a broadcast of fixed size.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    edge = "\x10" if mode == "dense" and not keep_origin else ""
    shared = docs.sparkSession.sparkContext.broadcast(ids.renderings(docs.sparkSession, mode))

    def written(p: Piece) -> tuple[str, int, int, int, int]:
        """What is written for a piece; its bytes, bytes as Vietnamese, whether it counts, and counts as a syllable."""
        syllable, counts, after = p.syllable_id is not None, len(p.token.encode("utf-8", "surrogatepass")) <= 255, p.fenced % 2
        shown = p.token
        if syllable:
            gap = " " if mode == "spare" else ""
            caret = "" if mode in ("parts", "utf8") or not p.first_upper else f"^^{gap}" if p.all_upper else f"^{gap}"
            shown = caret + shared.value[p.syllable_id]
        size = len(shown.encode("utf-8", "surrogatepass"))
        vietnamese = syllable or (p.category == "alphmark" and size <= 20)
        mark = edge if syllable else ""
        return mark + shown + mark + (" " if after or not counts else ""), counts * (size + 2 * len(mark) + after), counts * vietnamese * (size + 1), int(counts), int(counts and syllable)

    def of(distinct: list[str]):
        found = [written(read_piece(p)) for p in distinct]
        figures = np.array([x[1:] for x in found], np.int64).reshape(-1, 4)

        def columns(codes: np.ndarray, starts: np.ndarray) -> list:
            sums = np.vstack([np.zeros((1, 4), np.int64), np.cumsum(figures[codes], axis=0)])
            return [joined([x[0] for x in found], codes, starts), *(sums[starts[1:]] - sums[starts[:-1]]).T.copy()]

        return lambda codes, starts: [x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns(codes, starts)]

    rows = lines(docs, key, text).select(F.col(key).cast("long").alias(key), "line_no", "pieces")
    return piecewise(rows, f"{key} long, line_no int", "line string, line_bytes long, vi_bytes long, n_tokens long, n_syllables long", of)
