"""Best-fit packing of tokenised documents into sequences of at most SIZE tokens.

Only the histogram of piece lengths (at most SIZE numbers, at any corpus size) reaches the driver. There the plan is
made: the longest piece opens a sequence, and single, pair and triple length sums that fill the gap exactly are taken
as often as the counts allow; where none fits, the best-fitting length goes in and the smaller gap is tried again. A
plan's pattern stands for many equal sequences, so the plan has some thousands of patterns. Pieces learn their place
from their rank among the pieces of their length: ranks are counted within tasks, and tasks are offset by a window
over (length, task) counts, so that no length, however common, meets in one task.

Documents are cut only if longer than SIZE, into pieces of SIZE; the last may be shorter. Null text is empty: one piece
with the end token alone. Repeated rows are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .token_counts import tokenizer

SIZE, END, CACHE = 4096, 1, 400_000
_WORDS = re.compile(r"[^ \t\n\r]+").findall
#: Letters that composition leaves single and whose lower case is one of them; other characters between them.
_RUNS = re.compile(r"[a-zß-öø-ÿ]+|[^a-zß-öø-ÿ \t\n\r]+").findall
_SIMPLE = re.compile(r"[\x00-&(-\x7fÀ-ÖØ-öø-ÿ]*").fullmatch
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("rank", pa.int64())])


class Ids:
    """Token ids of whole texts through the word tokenizer.

    Its pattern never spans white space, so the ids of the words between spaces, tabs and line ends make up those of a
    text. In texts of ASCII and composed Latin-1 letters without apostrophes and special strings, runs of letters are
    parts of their own as well. Parts are kept for reuse in two generations of bounded size; what has left them is
    encoded again: that costs time, never results.
    """

    def __init__(self, path: str, most: int = CACHE) -> None:
        self.tok, self.most, self.known, self.old = tokenizer(path), most, {}, {}

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        for t in texts:
            parts = _RUNS(t.lower()) if _SIMPLE(t) and "<|" not in t else _WORDS(t)
            new = [w for w in dict.fromkeys(parts) if w not in self.known]
            if len(self.known) + len(new) > self.most:
                self.old, self.known = self.known, {}
                new = list(dict.fromkeys(parts))
            if new:
                self._learn(new)
            yield np.frombuffer(b"".join(map(self.known.__getitem__, parts)), "<u4")

    def _learn(self, new: list[str]) -> None:
        unknown = []
        for w in new:
            if (ids := self.old.get(w)) is not None:
                self.known[w] = ids
            else:
                unknown.append(w)
        for a in range(0, len(unknown), 4096):
            part = unknown[a : a + 4096]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[w] = array("I", e.ids).tobytes()


@lru_cache(maxsize=2)
def shared_ids(path: str) -> Ids:
    """One a process, so that what is known outlasts a task."""
    return Ids(path)


def plan(counts: np.ndarray, size: int = SIZE) -> list[tuple[list[int], int]]:
    """(lengths in order, how many such sequences) from counts by length; uses each piece once."""
    left, out = counts.astype(np.int64).copy(), []
    left[0] = 0
    for top in range(len(left) - 1, 0, -1):
        while left[top]:
            lengths, use = [top], {top: 1}
            free = left.copy()
            free[top] -= 1
            some = free > 0
            gap = size - top
            while gap:
                more = _exact(free, some, gap) or _best(some, gap)
                if not more:
                    break
                for x in more:
                    lengths.append(x)
                    use[x] = use.get(x, 0) + 1
                    free[x] -= 1
                    some[x] = free[x] > 0
                    gap -= x
            times = min(int(left[x]) // n for x, n in use.items())
            for x, n in use.items():
                left[x] -= n * times
            out.append((lengths, times))
    return out


def _pair(some: np.ndarray, free: np.ndarray, gap: int, most: int) -> tuple[int, int] | None:
    """The pair with sum gap whose longer length is the longest, at most `most`."""
    low, high = (gap + 1) // 2, min(most, gap - 1, len(some) - 1)
    if high < low:
        return None
    good = some[low : high + 1] & some[gap - high : gap - low + 1][::-1]
    if 2 * low == gap and free[low] < 2:
        good[0] = False
    i = len(good) - 1 - int(good[::-1].argmax())
    return (low + i, gap - low - i) if good[i] else None


def _exact(free: np.ndarray, some: np.ndarray, gap: int) -> list[int]:
    """One, two or three lengths that fill the gap exactly, with the longest possible first."""
    if gap < len(free) and some[gap]:
        return [gap]
    if pair := _pair(some, free, gap, len(free)):
        return list(pair)
    for a in np.flatnonzero(some[: min(gap, len(free))])[::-1].tolist():  # triples
        if 3 * a < gap:
            break
        if (pair := _pair(some, free, gap - a, a)) and all(free[x] >= n for x, n in Counter((a, *pair)).items()):
            return [a, *pair]
    return []


def _best(some: np.ndarray, gap: int) -> list[int]:
    """The longest length that fits the gap."""
    fits = some[: gap + 1][::-1]
    i = int(fits.argmax())
    return [len(fits) - 1 - i] if fits[i] else []


def places(patterns: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset) in order; ranks go up within a row."""
    rows, used, sequence = [], {}, 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            rows.append((x, used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        sequence += times
    out = np.array(rows, np.int64).reshape(-1, 4)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """The pieces of each document, with their rank among those of their length in their task."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seen, task = shared_ids(path), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for k, x in zip(batch.column(0).to_pylist(), ids.of([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                x = np.append(x, np.uint32(END)).astype("<u4")
                for i, a in enumerate(range(0, len(x), size)):
                    part = x[a : a + size]
                    yield k, i, a, len(part), zlib.crc32(part.tobytes()), task, int(seen[len(part)])
                    seen[len(part)] += 1

        for batch in stream:
            if batch.num_rows:
                yield from common.batches(SCHEMA, rows(batch))

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    spark, scratch = docs.sparkSession, common.Scratch(docs.sparkSession, "packing")
    held = scratch.keep(pieces(docs, path, key, text, size), "pieces")
    by_task = scratch.keep(held.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "counts")
    counts = np.zeros(size + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        counts[r["length"]] = r["n"]
    table = spark.sparkContext.broadcast(places(plan(counts, size)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = held.join(first, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank")).alias("rank"))
    schema = pa.schema([*list(SCHEMA)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        keys = (rows[:, 0] << 48) + rows[:, 1]
        for batch in stream:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(rows[at, 2] + rank - rows[at, 1]), pa.array(rows[at, 3])], schema=schema)

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
