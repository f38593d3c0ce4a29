"""Benchmark decontamination: CGK random walks, bit-sampling LSH over item-sized windows, exact edit verification.

Words (runs of letters, digits and underscores, lower case) are the symbols. A CGK walk reads a symbol, writes it, and
goes on to the next or stays as a random bit of (step, symbol) says; strings at a small edit distance then have outputs
at a small Hamming distance. For each window as long as an item, samples of BITS places of its walk are looked up among
the items' samples; each hit is verified by the exact edit distance of the item to the best substring around it. Walk and
sample are repeated until items with all the edits allowed, at random places, are found with probability RECALL: how
often that takes is worked out by edits allowed, from walks over made-up items. Exact copies need one walk only. An item
of more than LONG words is looked up by pieces of about PIECE words: if all its edits are allowed, those of one piece at
least are allowed for its length. The whole item is then verified around the places of its pieces. Windows of a text
that hold the same words walk once.

Items are a broadcast of checked size: more than BLOCK_BYTES of them are taken in blocks, each against all rows. A lossless
count filter runs first: of an item's n - 1 word pairs, a window within d edits holds at least n - 1 - 2d, so windows with
fewer pairs of the benchmark cannot match and get no walk. Nothing is shuffled.

A match is an edit distance of at most RATE of the item's words. Items or texts that are null or have no words match
nothing; items of fewer than LEAST words match by exact words only. Repeated rows give repeated results, one row for
each (row, item) with the least distance and the first place that has it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from . import common

RATE, LEAST, BITS, RECALL, BLOCK_BYTES = 0.15, 8, 3, 0.995, 16 << 20
LONG, PIECE = 512, 256
#: Made-up items, their walks, and the starts on either side of the true one, from which repeats are worked out; walks at a time.
TRIALS, TRIED, AROUND, WALKS = 200, 64, 2, 1 << 17
SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("n_words", pa.int32()), ("start", pa.int32())])
SCHEMA_SQL = "doc_id long, item_id long, distance int, n_words int, start int"
_WORDS = re.compile(r"\w+").findall


def words_of(text: str | None) -> list[str]:
    return _WORDS(text.lower()) if text else []


def allowed(n: int) -> int:
    return int(RATE * n) if n >= LEAST else 0


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of word pairs."""
    return common.mix(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64))


def needed(n: int) -> int:
    """The fewest word pairs of an item of n words that a match holds."""
    return n - 1 - 2 * allowed(n)


_C = np.uint64(0x9E3779B97F4A7C15)


def sampled(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: np.ndarray, seeds: np.ndarray, allowed_keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Walks over symbols[starts:ends], one for each row, and the keys of the symbols they write at their places.

    places: by row, the steps that are sampled, in order. A row whose key so far is not among allowed_keys (sorted) walks
    no further. Returns the rows that got through and all their keys; the last column is the whole key.
    """
    rows, at, nth = np.arange(len(starts)), starts.copy(), np.zeros(len(starts), np.int64)
    out = np.zeros((len(starts), places.shape[1]), np.uint64)
    key, done, end, salt = common.mix(seeds + np.uint64(1)), [], ends, seeds * np.uint64(1000003)
    for step in range(int(places.max(initial=-1)) + 1):
        if not len(rows):
            break
        s = np.where(at < end, symbols[np.minimum(at, len(symbols) - 1)], -1).view(np.uint64)
        now = np.flatnonzero(places[rows, nth] == step)
        if len(now):
            key[now] = common.mix(key[now] * _C + s[now])
            out[rows[now], nth[now]] = key[now]
            nth[now] += 1
            go = np.ones(len(rows), bool)
            if allowed_keys is not None:
                i = np.minimum(np.searchsorted(allowed_keys, key[now]), len(allowed_keys) - 1)
                go[now] = allowed_keys[i] == key[now]
            full = go & (nth == places.shape[1])
            done.append(rows[full])
            go &= ~full
            if not go.all():
                rows, at, nth, key, end, salt, s = (v[go] for v in (rows, at, nth, key, end, salt, s))
        at = at + (common.mix(s + (salt + np.uint64(step)) * _C) & np.uint64(1)).astype(np.int64)
    got = np.concatenate(done) if done else np.zeros(0, np.int64)
    return got, out[got]


def places_of(n: int, bits: int, repeats: int) -> np.ndarray:
    """For each repeat, the sampled steps. A walk over n symbols takes about 2n; samples stay inside."""
    rng, steps = np.random.default_rng(n), max(bits, 3 * n // 2)
    return np.stack([np.sort(rng.choice(steps, bits, replace=False)) for _ in range(repeats)])


def seeds_of(n: np.ndarray, nth: np.ndarray) -> np.ndarray:
    return n.astype(np.uint64) * np.uint64(1000003) + nth.astype(np.uint64)


def repeats_of(n: int, bits: int = BITS, recall: float = RECALL) -> int:
    """The walks that find an item of n words at allowed(n) edits with the probability asked for."""
    d = allowed(n)
    if not d:
        return 1  # equal windows have equal walks
    steps = 8
    while steps < d:
        steps += steps // 4
    return _repeats(steps if d > 8 else d, bits, recall)


@lru_cache(maxsize=256)
def _repeats(d: int, bits: int, recall: float) -> int:
    """The walks needed at d edits in the shortest item that allows as many."""
    n = next(n for n in count(LEAST) if allowed(n) >= d)
    rng, item, around = np.random.default_rng(d), np.arange(1, n + 1), min(d, AROUND)
    tried, found = np.arange(TRIED), np.zeros(TRIALS)
    places, seeds = places_of(n, bits, TRIED), seeds_of(np.full(TRIED, n), tried)
    got, keys = sampled(item, np.zeros(TRIED, np.int64), np.full(TRIED, n), places, seeds)
    final, known = np.zeros(TRIED, np.uint64), np.unique(keys)
    final[got] = keys[:, -1]
    for t in range(TRIALS):
        x = item.tolist()
        for _ in range(d):
            kind, i = int(rng.integers(3)), int(rng.integers(len(x)))
            x[i : i + (kind > 0)] = [0] * (kind < 2)  # a word more, another word, a word less
        starts = np.repeat(np.arange(2 * around + 1), TRIED)
        text = np.array([0] * around + x + [0] * (n + around), np.int64)
        got, keys = sampled(text, starts, starts + n, np.tile(places, (2 * around + 1, 1)), np.tile(seeds, 2 * around + 1), known)
        found[t] = len(np.unique(got[keys[:, -1] == final[got % TRIED]] % TRIED))
    lost = 1 - (found + 0.5) / (TRIED + 1)
    return next(r for r in count(1) if np.mean(lost**r) <= 1 - recall)


def _numbered(repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each walk of rows that walk so often: its row, and which of the row's walks it is."""
    each = np.repeat(np.arange(len(repeats)), repeats)
    return each, np.arange(len(each)) - np.repeat(np.cumsum(repeats) - repeats, repeats)


def _distances(item: list[int], text: list[int], anchored: bool) -> Iterator[int]:
    """For each end in the text, the edit distance of the item to what ends there: from the text's first word on if
    anchored, else from wherever it is least. A column of the table is two bit vectors: where it rises, where it falls.
    """
    n = len(item)
    full, last, is_at = (1 << n) - 1, 1 << (n - 1), {}
    for i, c in enumerate(item):
        is_at[c] = is_at.get(c, 0) | 1 << i
    rise, fall, now = full, 0, n
    for c in text:
        same = is_at.get(c, 0)
        level = (((same & rise) + rise) ^ rise) | same
        up, down = fall | (full & ~(level | rise)), rise & level
        now += bool(up & last) - bool(down & last)
        up, down = up << 1 | anchored, down << 1
        turn = same | fall
        rise, fall = (down | ~(turn | up)) & full, up & turn & full
        yield now


def best_substring(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edit distance of the item to a substring, the first start of those that end first): exact, by bit vectors."""
    if not len(text):
        return len(item), 0
    words, around = item.tolist(), text.tolist()
    ends = list(_distances(words, around, False))
    best = min(ends)
    if best >= len(item):
        return len(item), 0  # nothing of it is there
    end = ends.index(best) + 1
    backwards = list(_distances(words[::-1], around[max(0, end - len(item) - best) : end][::-1], True))
    return best, end - 1 - max(i for i, x in enumerate(backwards) if x == best)


def pieces(item: np.ndarray) -> list[np.ndarray]:
    """What an item is looked up by: itself, or all the different pieces of a long one."""
    if len(item) <= LONG:
        return [item]
    return list({x.tobytes(): x for x in np.array_split(item, len(item) // PIECE)}.values())


def _distinct(x: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The first start of each different window, and all starts of those that stand more than once."""
    power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(x), _C))])
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(x.view(np.uint64) + np.uint64(1)) * power[:-1])])
    ends = np.minimum(starts + n, len(x))
    key = common.mix((upto[ends] - upto[starts]) * power[len(x) - starts])  # equal words at any place: equal sums
    order = np.argsort(key, kind="stable")
    groups = np.split(starts[order], np.flatnonzero(np.diff(key[order])) + 1)
    return np.sort(np.array([g[0] for g in groups])), [(int(g[0]), g) for g in groups if len(g) > 1]


def _around(places: list[int], far: int, size: int) -> Iterator[tuple[int, int]]:
    """Parts of a text as far as `far` from the places, those that overlap made one."""
    begin, end = max(0, places[0] - far), places[0]
    for s in places:
        if s - far > end:
            yield begin, min(size, end)
            begin = s - far
        end = s + far
    yield begin, min(size, end)


class Items:
    """A block of the benchmark, ready to be looked up."""

    def __init__(self, items: list[tuple[int, str]], bits: int = BITS, recall: float = RECALL) -> None:
        self.symbols: dict[str, int] = {}
        self.items = [(k, np.array([self.symbols.setdefault(w, len(self.symbols) + 1) for w in ws], np.int64)) for k, t in items if (ws := words_of(t))]
        self.of = self.symbols.get
        parts = [(i, x) for i, (_, item) in enumerate(self.items) for x in pieces(item)]
        #: By length, for each repeat: the sampled steps.
        self.places = {n: places_of(n, bits, repeats_of(n, bits, recall)) for n in sorted({len(x) for _, x in parts})}
        #: Whole keys of walks in order, and the item of each; all that a walk may have as a key on its way.
        self.final, self.owner, self.keys = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint64)
        if self.items:
            owner, sizes = np.array([i for i, _ in parts], np.int32), np.array([len(x) for _, x in parts])
            each, nth = _numbered(np.array([len(self.places[n]) for n in sizes.tolist()]))
            stops = np.cumsum(sizes)
            got, keys = sampled(np.concatenate([x for _, x in parts]), (stops - sizes)[each], stops[each], np.concatenate([self.places[n] for n in sizes.tolist()]), seeds_of(sizes[each], nth))
            order = np.argsort(keys[:, -1], kind="stable")
            self.final, self.owner, self.keys = keys[order, -1], owner[each[got]][order], np.unique(keys)
        #: Lengths near each other, which share one count filter: (shortest, longest, all).
        self.classes: list[tuple[int, int, list[int]]] = []
        for n in self.places:
            if self.classes and n <= 1.25 * self.classes[-1][0]:
                least, _, those = self.classes[-1]
                self.classes[-1] = (least, n, [*those, n])
            else:
                self.classes.append((n, n, [n]))
        pairs = np.concatenate([np.zeros(0, np.uint64), *(_pair(x[:-1], x[1:]) for _, x in parts)])
        of = np.repeat(np.array([1 << len(x) % 64 for _, x in parts], np.uint64), np.array([len(x) - 1 for _, x in parts], np.int64))
        order = np.argsort(pairs, kind="stable")
        #: The word pairs of items in order, and for each a bit for every item length (mod 64) that has it.
        self.pairs, first = np.unique(pairs[order], return_index=True)
        self.masks = np.bitwise_or.reduceat(of[order], first) if len(first) else np.zeros(0, np.uint64)
        #: Whether any of them begins with these bits; most pairs of a text are turned away here.
        self.shift = np.uint64(64 - max(16, len(self.pairs).bit_length() + 4))
        self.begins = np.zeros(1 << (64 - int(self.shift)), bool)
        self.begins[self.pairs >> self.shift] = True

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, distance, words, start) for each item that the text holds."""
        return self.matches_of([text])[0]

    def matches_of(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """The matches of each text; the windows of all of them walk together."""
        xs = [np.fromiter(map(self.of, ws := words_of(t), repeat(0)), np.int64, len(ws)) for t in texts]
        found: list[dict[int, set[int]]] = [{} for _ in xs]
        rows: list[tuple[int, int, np.ndarray]] = []
        same: dict[tuple[int, int, int], np.ndarray] = {}
        for d, x in enumerate(xs):
            for n, starts in self._windows(x):
                most = max(1, WALKS // len(self.places[n]))
                if len(starts) > 1:
                    starts, others = _distinct(x, starts, n)
                    same |= {(d, n, a): those for a, those in others}
                rows += [(d, n, starts[i : i + most]) for i in range(0, len(starts), most)]
        base = np.cumsum([0, *map(len, xs)])
        symbols = np.concatenate([*xs, np.zeros(1, np.int64)])
        while rows:  # a bounded number of walks at a time
            part, size = [], 0
            while rows and size < WALKS:
                part.append(rows.pop())
                size += len(part[-1][2]) * len(self.places[part[-1][1]])
            doc = np.concatenate([np.full(len(s), d) for d, _, s in part])
            n = np.concatenate([np.full(len(s), n) for _, n, s in part])
            start = np.concatenate([s for _, _, s in part])
            begin = base[doc] + start
            end = np.minimum(begin + n, base[doc + 1])
            places = np.concatenate([np.tile(self.places[m], (len(s), 1)) for _, m, s in part])
            each, nth = _numbered(np.concatenate([np.full(len(s), len(self.places[m])) for _, m, s in part]))
            got, keys = sampled(symbols, begin[each], end[each], places, seeds_of(n[each], nth), self.keys)
            first, last = (np.searchsorted(self.final, keys[:, -1], side) for side in ("left", "right"))
            hit, nth = _numbered(last - first)
            w, i = each[got[hit]], self.owner[first[hit] + nth]
            for d, m, i, at in set(zip(doc[w].tolist(), n[w].tolist(), i.tolist(), start[w].tolist(), strict=True)):
                found[d].setdefault(i, set()).update(same.get((d, m, at), np.array([at])).tolist())
        return [sorted(self._verified(x, f)) for x, f in zip(xs, found, strict=True)]

    def _windows(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(length, starts) of the windows that pass the count filter."""
        if not len(x):
            return
        both = np.flatnonzero((x[:-1] > 0) & (x[1:] > 0))
        pairs = _pair(x[both], x[both + 1])
        may = self.begins[pairs >> self.shift]
        both, pairs = both[may], pairs[may]
        at = np.searchsorted(self.pairs, pairs)
        at[at == len(self.pairs)] = 0
        same = self.pairs[at] == pairs if len(self.pairs) else np.zeros(len(pairs), bool)
        both, masks = both[same], self.masks[at[same]]
        for _, most, lengths in self.classes:
            starts = self._starts(x, both, masks, lengths, np.arange(len(x)), most)
            for n in lengths if len(starts) else ():
                own = self._starts(x, both, masks, [n], starts, n)
                if len(own):
                    yield n, own

    def _verified(self, x: np.ndarray, found: dict[int, set[int]]) -> Iterator[tuple[int, int, int, int]]:
        """Exact edit distances around the hits."""
        for i, places in found.items():
            k, item = self.items[i]
            d, done, best = allowed(len(item)), -1, None
            if len(item) > LONG:
                for a, b in _around(sorted(places), len(item) + d, len(x)):
                    got, at = best_substring(item, x[a:b])
                    if got <= d and (best is None or got < best[0]):
                        best = got, a + at
                places = ()
            for s in sorted(places):
                a, b = max(0, s - 2 * d), min(len(x), s + len(item) + 2 * d)
                if s <= done:
                    continue
                if best and not best[0]:
                    break
                got, at = best_substring(item, x[a:b])
                done = s + d  # starts as near as this lie in the part just searched
                if got <= d and (best is None or got < best[0]):
                    best = got, a + at
            if best:
                yield k, best[0], len(item), best[1]

    def _starts(self, x: np.ndarray, both: np.ndarray, masks: np.ndarray, lengths: list[int], among: np.ndarray, most: int) -> np.ndarray:
        """Where a window for `most` words and the edits allowed holds the pairs that one of the lengths needs.

        The shortest length does not always need the fewest: where one more edit is allowed, a longer one needs less.
        """
        least = min(map(needed, lengths))
        if len(both) < least or len(x) < min(n - allowed(n) for n in lengths):
            return among[:0]
        bits = np.uint64(sum({1 << n % 64 for n in lengths}))
        mine = both[masks & bits > 0]
        if len(mine) < least:
            return among[:0]
        hit = np.zeros(len(x) + 1, np.int64)
        hit[mine + 1] = 1
        hit = np.cumsum(hit)
        among = among[x[among] > 0] if min(lengths) < 2 else among
        last = np.minimum(among + most + allowed(most) - 1, len(x) - 1)
        return among[hit[last] - hit[among] >= least]


def blocks(benchmark: DataFrame, item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The benchmark in blocks of bounded size."""
    items = benchmark.select(benchmark[item].cast("long").alias("k"), benchmark[item_text].cast("string").alias("t")).where("t is not null").distinct()
    size = items.agg(F.sum(F.octet_length("t") + 64).alias("n")).first()["n"] or 0
    n = math.ceil(1.25 * size / block_bytes) if size > block_bytes else 1
    for i in range(n):
        yield Items([(r["k"], r["t"]) for r in items.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == i).orderBy("k", "t").collect()])


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, distance, n_words, start for each item found in a row of docs."""
    rows, out = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")), None
    for block in blocks(benchmark, block_bytes=block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def each(batch: pa.RecordBatch, shared=shared) -> Iterator[tuple]:
            for k, found in zip(batch.column(0).to_pylist(), shared.value.matches_of(batch.column(1).to_pylist()), strict=True):
                for x in found:
                    yield k, *x

        found = rows.mapInArrow(common.by_rows(SCHEMA, each), SCHEMA_SQL)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in which no item is found; all columns stay. A filter: no join, no shuffle."""
    for block in blocks(benchmark, block_bytes=block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        docs = docs.where(_free(shared)(F.col(text).cast("string")))
    return docs


def _free(shared):
    @F.pandas_udf(BooleanType())
    def free(texts: pd.Series) -> pd.Series:
        return pd.Series([not found for found in shared.value.matches_of(texts.tolist())], dtype=bool)

    return free
