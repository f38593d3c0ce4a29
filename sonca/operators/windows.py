"""Counts of windows over lists of symbols, by one shuffle of buckets: short ones counted in slices, long ones by runs.

Of long windows nearly all are different, so nothing is gained by counting a batch. Instead of each window, runs are
shuffled: places that follow each other and have the same least hash among the pieces of their first symbols (a
minimizer, as k-mers are counted). A symbol then travels about once for a place, however many windows it is in. Equal
windows begin with equal symbols, so they have the same minimizer and meet in the same bucket, where they are counted.
Hashes only say where windows meet; windows are told apart by their symbols.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..schemas import BLANK
from .syllables import sliced

#: Whether the windows of a length count, from whether the symbols at each distance from its place are words.
Rule = Callable[[int, Callable[[int], np.ndarray]], np.ndarray]
#: Windows of more symbols than SHORT go by runs; a slice has about SYMBOLS; an input split has about 40 million places.
SHORT, SYMBOLS, BUCKETS, ROWS = 3, 1 << 19, 32, 1 << 16


def plain(n: int, word: Callable[[int], np.ndarray]) -> np.ndarray:
    """Up to three words without blanks; longer ones with blanks at one end at most."""
    inner = range(n) if n < 4 else range(1, n - 1)
    out = word(inner[0]).copy()
    for i in inner:
        out &= word(i)
    return out if n < 4 else out & (word(0) | word(n - 1))


def blanks(n: int, word: Callable[[int], np.ndarray]) -> np.ndarray:
    """After a blank all further symbols are words; after a word the second may be blank in pairs, and the last in fours."""
    if n == 1:
        return np.ones(len(word(0)), bool)
    return word(0) | word(1) if n == 2 else word(1) & word(2) if n == 3 else word(1) & word(2) & (word(0) | word(3))


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of columns."""
    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def distinct(columns: list[np.ndarray], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(one place, weight) of each distinct row of columns of numbers that are not negative. Rows of equal hashes are compared."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = max(int(max(c.max() for c in columns)).bit_length(), 1)
    packed = bits * len(columns) <= 63
    if packed:
        key = np.zeros(n, np.int64)
        for c in columns:
            key = (key << bits) | c
    else:
        key = _mixed(columns).view(np.int64)
    coded = pa.array(key).dictionary_encode()
    inverse, size = coded.indices.to_numpy(), len(coded.dictionary)
    at = np.zeros(size, np.int64)
    at[inverse[::-1]] = np.arange(n)[::-1]
    if not packed and not all(np.array_equal(c[at][inverse], c) for c in columns):
        _, at, inverse = np.unique(np.stack(columns, 1), axis=0, return_index=True, return_inverse=True)
        inverse = inverse.ravel()
    if weights is None:
        return at, np.bincount(inverse, minlength=len(at))
    sums = np.zeros(len(at), np.int64)
    np.add.at(sums, inverse, weights)
    return at, sums


class Symbols:
    """Lists of symbols, one after the other: each place's symbol, how many follow in its list, and whether it is a word."""

    def __init__(self, values: pa.Array, sizes: np.ndarray, longest: int) -> None:
        coded = values.dictionary_encode()
        self.names, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        self.n = len(self.codes)
        self.room = np.repeat(np.cumsum(sizes), sizes) - np.arange(self.n)
        known = np.append(pc.not_equal(self.names, BLANK).to_numpy(zero_copy_only=False).astype(bool), False)
        self.padded = np.concatenate([self.codes, np.full(longest, len(self.names), self.codes.dtype)])
        self.words = known[self.padded]

    def good(self, n: int, rule: Rule) -> np.ndarray:
        """Whether a window of n that counts begins at each place."""
        return (self.room >= n) & rule(n, lambda i: self.words[i : i + self.n])

    def columns(self, at: np.ndarray, n: int) -> list[np.ndarray]:
        return [self.padded[at + i] for i in range(n)]

    def grams(self, at: np.ndarray, n: int) -> pa.Array:
        parts = [self.names.take(pa.array(self.codes[at + i])) for i in range(n)]
        return pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]


def _of(column: pa.Array, longest: int) -> Symbols:
    return Symbols(column.flatten(), column.value_lengths().fill_null(0).to_numpy().astype(np.int64), longest)


def _pieces(least: int) -> int:
    """Symbols of the pieces whose hashes are compared, of the first `least` symbols of a window."""
    return 3 if least > 5 else 2


def _exact(s: Symbols, own: np.ndarray, n: int, rule: Rule) -> tuple[np.ndarray, ...]:
    """Of each distinct window of n symbols: place, 0, n, count and a hash."""
    places = np.flatnonzero(s.good(n, rule))
    at, count = distinct(s.columns(places, n))
    first = places[at]
    return first, np.zeros(len(first), np.int64), np.full(len(first), n), count, _mixed([own[first + i] for i in range(n)])


def _runs(s: Symbols, own: np.ndarray, lengths: list[int], rule: Rule) -> tuple[np.ndarray, ...]:
    """Of each distinct run of places: the first one, how many, how many symbols, count and the minimizer."""
    least, piece = min(lengths), _pieces(min(lengths))
    most = least - piece + 1
    best = np.zeros(s.n, np.int64)
    for n in sorted(lengths):
        best[s.good(n, rule)] = n
    places = np.flatnonzero(best)
    if not len(places):
        return (places,) * 4 + (places.astype(np.uint64),)
    mixed = np.append(_mixed([own[i : i + s.n] for i in range(piece)]), np.zeros(least, np.uint64))
    hashes = mixed[places]
    for i in range(1, most):
        np.minimum(hashes, mixed[places + i], out=hashes)
    new = np.ones(len(places), bool)
    new[1:] = (np.diff(places) != 1) | (hashes[1:] != hashes[:-1])
    since = np.arange(len(places)) - np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
    starts = np.flatnonzero(since % most == 0)
    first, n_places = places[starts], np.diff(np.append(starts, len(places)))
    size = np.maximum.reduceat(places + best[places], starts) - first
    at, count = distinct([n_places, size, *[np.where(i < size, s.padded[np.minimum(first + i, s.n)].astype(np.int64) + 1, 0) for i in range(int(size.max()))]])
    return first[at], n_places[at], size[at], count, hashes[starts[at]]


def _bucketed(s: Symbols, lengths: list[int], rule: Rule, buckets: int) -> pa.RecordBatch | None:
    """A row for each bucket with its runs: the symbols of all, how many places and symbols each has, and how often it stands."""
    long = [n for n in lengths if n > SHORT]
    own = np.array([*(zlib.crc32(x) for x in s.names.cast(pa.binary()).to_pylist()), 0], np.uint64)[s.padded]
    found = [_exact(s, own, n, rule) for n in lengths if n <= SHORT] + ([_runs(s, own, long, rule)] if long else [])
    first, n_places, size, count, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(first):
        return None
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first, n_places, size, count, bucket = (x[order] for x in (first, n_places, size, count, bucket))
    ends = np.cumsum(size)
    index = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(bucket) != 0)), len(bucket))
    lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, ends)[cuts], pa.int64()), s.names.take(pa.array(s.codes[index])))
    codec = pa.Codec("zstd", 1)
    texts, runs, raw = [], [], []
    for i, x in enumerate(pc.binary_join(lists, " ").cast(pa.binary()).to_pylist()):
        part = slice(cuts[i], cuts[i + 1])
        raw.append(len(x))
        texts.append(codec.compress(x, asbytes=True))
        runs.append(n_places[part].astype(np.uint16).tobytes() + size[part].astype(np.uint16).tobytes() + count[part].astype(np.int64).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int32()), pa.array(raw, pa.int64()), pa.array(texts, pa.binary()), pa.array(runs, pa.binary())], names=["bucket", "raw", "texts", "runs"])


def _counted(table: pa.Table, lengths: list[int], rule: Rule) -> Iterator[tuple[int, Symbols, np.ndarray, np.ndarray]]:
    """(length, symbols, places, counts) of the distinct windows of a bucket."""
    codec = pa.Codec("zstd")
    texts = [codec.decompress(t, n, asbytes=True).decode() for t, n in zip(table["texts"].to_pylist(), table["raw"].to_pylist(), strict=True)]
    runs = [(x, len(x) // 12) for x in table["runs"].to_pylist()]
    n_places, size = (np.concatenate([np.frombuffer(x, np.uint16, n, 2 * i * n) for x, n in runs]).astype(np.int64) for i in (0, 1))
    count = np.concatenate([np.frombuffer(x, np.int64, n, 4 * n) for x, n in runs])
    # a window of its own is a run of no places
    s = Symbols(pc.split_pattern(pa.array(texts, pa.large_string()), " ").flatten().cast(pa.string()), size, max(lengths))
    first, ends = np.cumsum(size) - size, np.cumsum(n_places)
    places = np.arange(ends[-1]) + np.repeat(first - (ends - n_places), n_places)
    weights = np.repeat(count, n_places)
    for n in lengths:
        own = (n_places == 0) & (size == n) if n <= SHORT else s.good(n, rule)[places]
        begun, often = (first[own], count[own]) if n <= SHORT else (places[own], weights[own])
        at, sums = distinct(s.columns(begun, n), often)
        yield n, s, begun[at], sums


def counted(rows: DataFrame, lengths: Iterable[int], rule: Rule, sizes: bool = False) -> DataFrame:
    """n, gram, n_count of the windows of each length over the lists in column s; or, with sizes, n, n_count, n_grams: how
    many grams have each count (in several rows), for which no gram need be written out. A text is read once."""
    lengths, rows = sorted(set(lengths)), rows.select("s")
    buckets = BUCKETS * max(1, rows.rdd.getNumPartitions())

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in (_of(x.column(0), max(lengths)) for b in stream for x in sliced(b, SYMBOLS)):
            if (made := _bucketed(s, lengths, rule, buckets)) is not None:
                yield made

    def grams(table: pa.Table) -> pa.Table:
        out = []
        for n, s, at, count in _counted(table, lengths, rule):
            for i in range(0, max(len(at), 1), ROWS):
                part = at[i : i + ROWS]
                out.append(pa.table([pa.array(np.full(len(part), n), pa.int32()), s.grams(part, n), pa.array(count[i : i + ROWS], pa.int64())], names=["n", "gram", "n_count"]))
        return pa.concat_tables(out)

    def counts(table: pa.Table) -> pa.Table:
        found = [(n, *np.unique(count, return_counts=True)) for n, _, _, count in _counted(table, lengths, rule)]
        columns = [np.concatenate(x) for x in zip(*[(np.full(len(c), n, np.int32), c, k) for n, c, k in found], strict=True)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["n", "n_count", "n_grams"])

    bucketed = rows.mapInArrow(run, "bucket int, raw long, texts binary, runs binary").groupBy("bucket")
    return bucketed.applyInArrow(counts, "n int, n_count long, n_grams long") if sizes else bucketed.applyInArrow(grams, "n int, gram string, n_count long")
