"""Exact removal of repeated word windows, partitioned by super-k-mers.

A window is WINDOW consecutive words (bytes between ASCII white space). Its minimiser is its M-gram of words with the
smallest hash, the first of equals. Consecutive windows with the minimiser in the same place form a super-k-mer: one
packed string that goes to its minimiser's bucket. Equal windows have equal minimisers at equal places inside them, so
they meet in a bucket, where windows are sorted and compared as the strings they are; hashes only choose the bucket.

Buckets travel in parts of about PART_BYTES (up to LARGE times as many where there are very many parts). A task packs the strings that it
has for a part together and compresses them. It sends a packed string again only for an earlier place; its later repeats
are removed at once. A minimiser may stand in a third of all texts (what surrounds a common passage differs). A task that
holds many strings of one bucket splits it by the finest minimiser, the whole window: it sends windows, and a mark so that
the bucket's other strings are taken apart the same way by the task that gets them. No task gets more than `hot` strings
of a bucket from another, and `hot` falls as tasks grow in number. A part that outgrows what a task may hold is taken
apart likewise, piece by piece. Windows are dealt by their own hash and read in order of place, so that one place at a
time is held, however often a window repeats. None of this changes what is found.

What is removed: each word that a window covers whose words also start earlier (smaller doc_id; in rows that share a
doc_id, the text with the smaller hash; in one text, earlier), judged on the input. Each row stands for itself: rows that
share a doc_id, or have none, but not a text are different documents. Rows that repeat a doc_id and its text are one
document, and all get what it gets. A null doc_id comes before all others. Null text has no words. Texts with fewer words
than a window stay whole. Columns other than the key and the text are carried along untouched by `clean`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import common

WINDOW, M = 20, 6
#: Bytes of packed strings: of a part, on average; that a task holds of one part; that it packs at a time; that it remembers.
PART_BYTES, HELD_BYTES, PACKED_BYTES, SEEN_BYTES = 2 << 20, 96 << 20, 16 << 20, 48 << 20
#: More parts than MANY are made only once they would have LARGE times PART_BYTES: a task should have several strings for each.
MANY, LARGE = 1 << 14, 16
#: Strings of a bucket that a task sends at least before it splits the bucket; counters for that (a shared one only splits earlier).
HOT, COUNTERS = 16, 1 << 21
#: Stands for a null key, which so comes first.
NONE = -(1 << 63)
#: Windows of a run at most: two bytes hold how many.
MOST = (1 << 16) - 1
#: What travels: for a part, compressed records of one kind. Parts below 0 belong to no bucket and only spread what they hold.
SENT = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("records", pa.binary())])
SENT_SQL = "part long, kind int, records binary"
KNOWN, WINDOWS, MARKS, STRINGS = range(4)
#: A record: bucket, document, hash of its text, first window, windows, and a string (none for known repeats and marks).
FIELDS = (np.uint32, np.int64, np.int64, np.uint32, np.uint16)
#: Runs of windows to remove, or (with words) a window that is judged by itself.
RUNS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("words", pa.binary())])
RUNS_SQL = "doc_id long, text_hash long, start long, n long, words binary"
Place = tuple[int, int, int]


def packed_records(columns: list[np.ndarray], strings: list[bytes]) -> bytes:
    """Columns of FIELDS and strings as compressed bytes."""
    sizes = np.fromiter(map(len, strings), np.uint32, len(strings))
    parts = [np.uint32(len(strings)).tobytes(), *(np.asarray(c, t).tobytes() for c, t in zip(columns, FIELDS, strict=True)), sizes.tobytes(), *strings]
    return zstandard.compress(b"".join(parts), 1)


def opened_records(records: bytes) -> tuple[list[np.ndarray], np.ndarray, bytes]:
    """The columns, where each string begins and ends, and the bytes they lie in."""
    raw = zstandard.decompress(records)
    n, at, columns = int.from_bytes(raw[:4], "little"), 4, []
    for t in (*FIELDS, np.uint32):
        columns.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return columns[:-1], at + np.concatenate([[0], np.cumsum(columns[-1], dtype=np.int64)]), raw


class SuperKmers:
    """The runs of a text's windows that share a minimiser; empty if the text is shorter than a window."""

    def __init__(self, words: list[bytes], window: int = WINDOW, m: int = M) -> None:
        m = min(m, window)
        self.text, self.window = b" ".join(words), window
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        if len(words) < window:
            self.bucket, self.begin, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        hashes = common.grams(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), m)
        least = window - m + 1
        where = np.lib.stride_tricks.sliding_window_view(hashes, least).argmin(1) + np.arange(len(hashes) - least + 1)
        self.begin = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1])
        self.n = np.diff(np.append(self.begin, len(where)))
        self.bucket = common.mix(hashes[where[self.begin]] + np.uint64(1))  # the smallest hashes are no even sample of all

    def strings(self) -> Iterator[bytes]:
        for x, y in zip(self.starts[self.begin].tolist(), self.ends[self.begin + self.n + self.window - 2].tolist(), strict=True):
            yield self.text[x:y]

    def windows(self, run: int) -> Iterator[tuple[int, bytes]]:
        """(start, words) of each window of a run."""
        a, b = int(self.begin[run]), int(self.begin[run] + self.n[run])
        for i, x, y in zip(range(a, b), self.starts[a:b].tolist(), self.ends[a + self.window - 1 : b + self.window - 1].tolist(), strict=True):
            yield i, self.text[x:y]


def merged(runs: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(start, n) of runs in order, those that follow on each other made one, of at most MOST windows."""
    begin = end = 0
    for i, n in runs:
        if i != end or i + n - begin > MOST:
            if end > begin:
                yield begin, end - begin
            begin = i
        end = i + n
    if end > begin:
        yield begin, end - begin


class Sender:
    """What one task has to send: packed strings by part, windows of split buckets, and removals known already."""

    def __init__(self, window: int, m: int, parts: int, hot: int) -> None:
        self.window, self.m, self.parts, self.hot = window, m, np.uint64(parts), hot
        self.seen: dict[bytes, Place] = {}
        self.counts, self.marked, self.seen_bytes = np.zeros(COUNTERS, np.uint32), set(), 0
        self._empty()

    def _empty(self) -> None:
        self.columns: list[tuple[np.ndarray, ...]] = []
        self.strings: list[bytes] = []
        self.marks: list[tuple[int, int]] = []
        self.known: list[Place | tuple[int, int, int, int]] = []
        self.windows: list[tuple[Place, bytes]] = []
        self.size = 0

    def _new(self, x: bytes, place: Place) -> bool | None:
        """Whether a string or window has to be sent: not if it is known from an earlier place (False) or this one (None)."""
        first = self.seen.get(x)
        if first is not None and first <= place:
            return False if first < place else None
        if first is None:
            self.seen_bytes += len(x) + 250
            if self.seen_bytes > SEEN_BYTES:
                self.seen.clear()
                self.seen_bytes = len(x) + 250
        self.seen[x] = place
        return True

    def add(self, k: int, h: int, text: bytes) -> None:
        s = SuperKmers(text.split(), self.window, self.m)
        if not len(s.begin):
            return
        part = ((s.bucket >> np.uint64(32)) * self.parts) >> np.uint64(32)
        low = (s.bucket & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        at = (s.bucket % np.uint64(COUNTERS)).astype(np.int64)
        np.add.at(self.counts, at, 1)
        split = self.counts[at] > self.hot
        keep, known = [], []
        for j, (i, n, x, hot) in enumerate(zip(s.begin.tolist(), s.n.tolist(), s.strings(), split.tolist(), strict=True)):
            if hot:
                if (mark := (int(part[j]), int(low[j]))) not in self.marked:
                    self.marked.add(mark)
                    self.marks.append(mark)
                for w, words in s.windows(j):
                    new = self._new(words, (k, h, w))
                    if new:
                        self.windows.append(((k, h, w), words))
                        self.size += len(words) + 100
                    elif new is False:
                        known.append((w, 1))
            elif new := self._new(x, (k, h, i)):
                keep.append(j)
                self.strings.append(x)
                self.size += len(x) + 100
            elif new is False:
                known.append((i, n))
        if keep:
            n = len(keep)
            self.columns.append((part[keep], low[keep], np.full(n, k), np.full(n, h), s.begin[keep], s.n[keep]))
        self.known += [(k, h, i, n) for i, n in merged(known)]

    def sent(self) -> Iterator[tuple[int, int, bytes]]:
        """(part, kind, records) of all that is held, which is then forgotten."""
        spread = lambda h: -1 - (h & 0x7FFFFFFF)
        for a in range(0, len(self.known), 8192):
            k, h, i, n = zip(*self.known[a : a + 8192], strict=True)
            yield spread(h[0]), KNOWN, packed_records([np.zeros(len(k)), k, h, i, n], [b""] * len(k))
        for a in range(0, len(self.windows), 8192):
            places, words = zip(*self.windows[a : a + 8192], strict=True)
            k, h, i = zip(*places, strict=True)
            yield spread(h[0]), WINDOWS, packed_records([np.zeros(len(k)), k, h, i, np.ones(len(k))], list(words))
        for part, low in self.marks:
            yield part, MARKS, packed_records([np.array([low]), *[np.zeros(1)] * 4], [b""])
        if self.columns:
            part, *columns = (np.concatenate(c) for c in zip(*self.columns, strict=True))
            order = np.argsort(part, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(part[order])) + 1).tolist(), len(order)]
            for a, b in pairwise(cuts):
                mine = order[a:b]
                yield int(part[mine[0]]), STRINGS, packed_records([c[mine] for c in columns], [self.strings[j] for j in mine.tolist()])
        self._empty()


def _sent(window: int, m: int, parts: int, hot: int):
    """mapInArrow: documents (doc_id, text_hash, text) to what travels."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(window, m, parts, hot)
        for batch in stream:
            for k, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.utf8(batch.column(2)), strict=True):
                out.add(k, h, t)
                if out.size > PACKED_BYTES or len(out.known) > 1 << 16:
                    yield from common.batches(SENT, out.sent())
        yield from common.batches(SENT, out.sent())

    return run


def judge(group: list[tuple[Place, bytes]], window: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[Place, bytes]]]:
    """Of a bucket's packed strings: (doc_id, text_hash, start, n) of windows that also start earlier, and each window's first place.

    Windows are sorted as strings.
    """
    found, gone, firsts = [], [], []
    for (k, h, i), packed in group:
        ends = np.cumsum(np.fromiter(map(len, packed.split(b" ")), np.int64) + 1) - 1
        starts, ends = [0, *(ends[:-1] + 1).tolist()], ends.tolist()
        found += [(packed[x:y], (k, h, i + j)) for j, (x, y) in enumerate(zip(starts, ends[window - 1 :], strict=False))]
    found.sort()
    before = None
    for words, place in found:
        if words != before:
            before, first = words, place
            firsts.append((first, words))
        elif place != first:
            gone.append(place)
    gone.sort()
    runs, at = [], 0
    for end in range(1, len(gone) + 1):  # windows that follow each other become one run
        k, h, i = gone[at]
        if end == len(gone) or gone[end][:2] != (k, h) or gone[end][2] - gone[end - 1][2] > 1:
            runs.append((k, h, i, gone[end - 1][2] - i + 1))
            at = end
    return runs, firsts


class Part:
    """The strings of one part that a task has got, as the columns they came in."""

    def __init__(self, window: int, most: int) -> None:
        self.window, self.most, self.marked, self.taken_apart = window, most, set(), False
        self.held: list[tuple[list[np.ndarray], np.ndarray, bytes]] = []
        self.size = 0

    def add(self, records: bytes) -> Iterator[tuple]:
        self.held.append(opened_records(records))
        self.size += len(self.held[-1][2])
        if self.size > self.most:
            self.taken_apart = True
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        """Runs to remove, and the windows that are judged by themselves, of what is held; it is then forgotten."""
        if not self.held:
            return
        buckets = np.concatenate([c[0] for c, _, _ in self.held])
        source = np.repeat(np.arange(len(self.held)), [len(c[0]) for c, _, _ in self.held])
        nth = np.concatenate([np.arange(len(c[0])) for c, _, _ in self.held])
        order = np.argsort(buckets, kind="stable")
        for a, b in pairwise([0, *(np.flatnonzero(np.diff(buckets[order])) + 1).tolist(), len(order)]):
            apart = self.taken_apart or int(buckets[order[a]]) in self.marked
            if b - a == 1 and not apart:  # alone in its bucket: nothing can be equal to its windows, which are different
                continue
            group = []
            for j in order[a:b].tolist():
                (_, k, h, i, _), ends, raw = self.held[source[j]]
                x = nth[j]
                group.append(((int(k[x]), int(h[x]), int(i[x])), raw[ends[x] : ends[x + 1]]))
            runs, firsts = judge(group, self.window)
            for r in runs:
                yield *r, None
            for place, words in firsts if apart else ():
                yield *place, 1, words
        self.held, self.size = [], 0


def _received(window: int, most: int):
    """mapInArrow over rows sorted by part and kind: runs to remove, and windows that are judged by themselves."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Part(window, most)

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            nonlocal now, held
            for part, kind, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    yield from held.close()
                    now, held = part, Part(window, most)
                if kind == STRINGS:
                    yield from held.add(records)
                    continue
                (bucket, *place), ends, raw = opened_records(records)
                if kind == MARKS:
                    held.marked.update(bucket.tolist())
                    continue
                for k, h, i, n, x, y in zip(*(c.tolist() for c in place), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    yield k, h, i, n, raw[x:y] if kind == WINDOWS else None

        for batch in stream:
            yield from common.batches(RUNS, rows(batch), 8192)
        yield from common.batches(RUNS, held.close(), 8192)

    return run


def _later(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over windows (h, doc_id, text_hash, start, words) in that order: all that are not the first of their words."""
    schema = pa.schema(list(RUNS)[:4])
    now, first = None, {}

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        nonlocal now, first
        for w, k, h, i, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if w != now:
                now, first = w, {}
            if first.setdefault(words, (k, h, i)) != (k, h, i):
                yield k, h, i, 1

    for batch in stream:
        yield from common.batches(schema, rows(batch), 8192)


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, m: int = M, part_bytes: int = PART_BYTES, held_bytes: int = HELD_BYTES, hot: int | None = None) -> DataFrame:
    """doc_id, text_hash, start, n: runs of windows that also start earlier; written in the shared folder.

    hot: strings of a bucket that a task sends before it splits the bucket; from the number of tasks if not given.
    """
    spark, scratch = docs.sparkSession, common.Scratch(docs.sparkSession, "substrings")
    t = docs[text].cast("string")
    rows = docs.select(F.coalesce(docs[key].cast("long"), F.lit(NONE)).alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    run = (window - min(m, window) + 2) / 2  # windows of a super-k-mer, on average
    share = size * (1 + (window - 1) / run) / part_bytes
    parts = math.ceil(max(share / LARGE, min(share, MANY), 4 * spark.sparkContext.defaultParallelism))
    hot = max(HOT, part_bytes // (256 * max(1, rows.rdd.getNumPartitions()))) if hot is None else hot
    sent = rows.mapInArrow(_sent(window, m, parts, hot), SENT_SQL)
    dealt = sent.repartition("part").sortWithinPartitions("part", "kind")
    judged = scratch.keep(dealt.mapInArrow(_received(window, held_bytes), RUNS_SQL), "judged")
    runs, alone = judged.where("words is null").drop("words"), judged.where("words is not null")
    if alone.isEmpty():
        return runs
    each = alone.select(F.xxhash64("words").alias("h"), "doc_id", "text_hash", "start", "words")
    later = each.repartition("h").sortWithinPartitions("h", "doc_id", "text_hash", "start").mapInArrow(_later, "doc_id long, text_hash long, start long, n long")
    return runs.unionByName(scratch.keep(later, "later"))


def _covered(n_words: int, starts: list[int], counts: list[int], window: int) -> np.ndarray:
    """By word, whether a window of the runs covers it."""
    edge = np.zeros(n_words + 1, np.int64)
    s = np.array(starts, np.int64)
    np.add.at(edge, s, 1)
    np.add.at(edge, np.minimum(s + np.array(counts, np.int64) - 1 + window, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def _with_runs(docs: DataFrame, runs: DataFrame, key: str, text: str) -> DataFrame:
    """docs with the runs of each row as arrays, null if it has none."""
    by_row = runs.groupBy(F.col("doc_id").alias("__sonca_key"), F.col("text_hash").alias("__sonca_hash")).agg(F.collect_list(F.struct("start", "n")).alias("__sonca_runs"))
    same = (F.coalesce(docs[key].cast("long"), F.lit(NONE)) == by_row["__sonca_key"]) & (F.xxhash64(docs[text].cast("string")) == by_row["__sonca_hash"])
    return docs.join(by_row, same, "left").drop("__sonca_key", "__sonca_hash")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, m: int = M, **sizes: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row."""
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def each(batch: pa.RecordBatch) -> Iterator[tuple]:
        runs = batch.column(2).to_pylist()
        for k, t, r in zip(batch.column(0).to_pylist(), common.utf8(batch.column(1)), runs, strict=True):
            words, gone = t.split(), 0
            n = len(words)
            if r:
                out = _covered(n, [x["start"] for x in r], [x["n"] for x in r], window)
                gone = int(out.sum())
                words = [w for w, o in zip(words, out.tolist(), strict=True) if not o]
            yield k, n, gone, hashlib.sha256(b" ".join(words)).hexdigest()

    joined = _with_runs(rows, repeated(rows, window=window, m=m, **sizes), "doc_id", "text")
    return joined.select("doc_id", "text", "__sonca_runs").mapInArrow(common.by_rows(schema, each), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut(text: str, starts: list[int], counts: list[int], window: int) -> str:
    """The text without the covered words and the white space after them; what is left stands as it stood."""
    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    gone = _covered(len(spans), starts, counts, window).tolist()
    out, at = [], 0
    for i, ((a, _), g) in enumerate(zip(spans, gone, strict=True)):
        if g:
            out.append(text[at:a])
            at = spans[i + 1][0] if i + 1 < len(spans) else len(text)
    return "".join([*out, text[at:]])


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, m: int = M, **sizes: int) -> DataFrame:
    """docs with the repeated words cut from their texts; rows and other columns stay, texts without repeats too."""
    joined = _with_runs(docs, repeated(docs, key, text, window, m, **sizes), key, text)

    @F.pandas_udf(StringType())
    def without(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return texts.combine(runs, lambda t, r: t if t is None or r is None else cut(t, [x["start"] for x in r], [x["n"] for x in r], window))

    done = F.when(F.col("__sonca_runs").isNull(), F.col(text)).otherwise(without(F.col(text), F.col("__sonca_runs")))
    return joined.withColumn(text, done).select(*docs.columns)
