"""Texts read in Arrow batches: tokens and symbols by one regular expression, told apart by a batch's dictionary.

A token costs one match; what depends on its letters alone is found once for each distinct token of a batch.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import ALPHA, BLANK, ESCAPED, SPACE

_ESCAPES = re.compile(r"\\[rt]")
_TOKENS = re.compile(f"[{ALPHA}]+|[\n{ESCAPED}]|[^{ALPHA}{SPACE}\n{ESCAPED}]+")
_SYMBOLS = re.compile(f"[{ALPHA}]+|[^{ALPHA}{SPACE}][^{ALPHA}]*")
_SPACED = re.compile(f"(?:[{ALPHA}]+|[^{ALPHA}{SPACE}]+)[{SPACE}]?")
is_word = re.compile(f"[{ALPHA}]").match

#: Characters of texts that are cut before what was found in them is passed on.
TEXTS = 1 << 21
#: Distinct tokens that a task holds before it passes on their counts, and rows that it passes on at once.
TYPES, ROWS = 1 << 18, 1 << 14


def prepared(text: str | None) -> str:
    """The text with its escapes resolved; null is empty."""
    return _ESCAPES.sub(" ", text or "").replace("\\n", ESCAPED)


def tokens_of(text: str | None) -> list[str]:
    """A text's tokens, and the newline that is added to it; an escaped newline as ESCAPED."""
    return _TOKENS.findall(prepared(text) + "\n")


def symbols_of(text: str | None) -> list[str]:
    """A text's words, and something else where BLANK stands: one for all that follow each other, and at either end."""
    return _SYMBOLS.findall(f"\n{prepared(text)}\n")


def _slices(column: pa.Array, most: int = TEXTS) -> Iterator[tuple[int, list[str | None]]]:
    """(where it begins, texts) of slices of about `most` bytes of a column of texts."""
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(column)]
    for first, last in zip(cuts, cuts[1:]):
        if last > first:
            yield first, column.slice(first, last - first).to_pylist()


def _flat(texts: list[str | None], cut: Callable[[str | None], list[str]]) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Where each text's tokens begin (and the last ones end), and all of them."""
    found = [cut(t) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
    return starts, pa.array([t for x in found for t in x], pa.string()).dictionary_encode()


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """token, n: how often each token stands, newlines included. A task keeps up to about TYPES of them together."""

    def rows_of(held: dict[str, int]) -> Iterator[pa.RecordBatch]:
        names, counts = pa.array(["\\n" if x == ESCAPED else x for x in held], pa.string()), pa.array(held.values(), pa.int64())
        for i in range(0, len(names), ROWS):
            yield pa.RecordBatch.from_arrays([names.slice(i, ROWS), counts.slice(i, ROWS)], names=["token", "n"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for texts in (x for batch in stream for _, x in _slices(batch.column(0))):
            for x, n in Counter(chain.from_iterable(map(tokens_of, texts))).items():
                held[x] = held.get(x, 0) + n
            if len(held) > TYPES:
                yield from rows_of(held)
                held = {}
        yield from rows_of(held)

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "token string, n long")
    return rows.groupBy("token").agg(F.sum("n").alias("n"))


def symbols(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, s: the words of each text in order; BLANK where other tokens stand, once for all that follow each other."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for first, texts in _slices(batch.column(1)):
                starts, t = _flat(texts, symbols_of)
                named = pa.array([x if is_word(x) else BLANK for x in t.dictionary.to_pylist()], pa.string())
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), named.take(t.indices))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), lists], names=[key, "s"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, s array<string>")


def line_figures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no, line_bytes, vi_bytes, n_tokens: see `lines.stats`."""

    def cut(text: str | None) -> list[str]:
        return _SPACED.findall(prepared(text).replace(ESCAPED, f" {ESCAPED} ").replace("\n", " \n ") + " ")

    def figures(piece: str) -> tuple[int, int, int, int]:
        """Bytes of a piece, its bytes as Vietnamese, whether it counts; whether it ends a line."""
        core = piece.rstrip(SPACE)
        if core == "\n":
            return 0, 0, 0, 1
        size = 2 if core == ESCAPED else len(core.encode())
        if size > 255:
            return 0, 0, 0, 0
        marked = is_word(core) and not core.isascii()
        return size + (len(core) < len(piece)), size + 1 if marked and size <= 20 else 0, 1, 0

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for first, texts in _slices(batch.column(1)):
                starts, t = _flat(texts, cut)
                made = np.array([figures(x) for x in t.dictionary.to_pylist()], np.int64).reshape(-1, 4)[t.indices.to_numpy()]
                sums = np.vstack([np.zeros((1, 3), np.int64), np.cumsum(made[:, :3], axis=0)])
                # a line ends at its newline, and each text's last one with the text
                ends = np.sort(np.concatenate([np.flatnonzero(made[:, 3]), starts[1:]]), kind="stable")
                n_lines = 1 + np.add.reduceat(np.append(made[:, 3], 0), starts[:-1]) * (np.diff(starts) > 0)
                begun = np.concatenate([[0], np.cumsum(n_lines)[:-1]])
                numbers = np.arange(len(ends)) - np.repeat(begun, n_lines)
                found = np.diff(sums[np.concatenate([[0], ends])], axis=0)
                keys = batch.column(0).slice(first, len(texts)).take(pa.array(np.repeat(np.arange(len(texts)), n_lines)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(numbers, pa.int32()), *[pa.array(x, pa.int64()) for x in found.T.copy()]], names=[key, "line_no", "line_bytes", "vi_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, line_no int, line_bytes long, vi_bytes long, n_tokens long")
