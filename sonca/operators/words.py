"""Words over syllables: dictionary lattice, best segmentation, and restoring tones and marks.

Sentences are rows with arrays; a dictionary is a table (word, n) whose words join their syllables with a space. A
dictionary of at most MOST words and MOST_BYTES is a broadcast, and a sentence's lattice is made in its row: nothing is
shuffled. Of a larger one the most frequent words are a broadcast. The others are looked up by a join, which gets only
those runs of syllables that a filter of the other words lets through: it misses none, and the join drops what it lets
through wrongly. All ways find the same.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.columns import let
from . import filters

LONGEST, MOST, MOST_BYTES = 4, 1_000_000, 64 << 20
#: Flags of a syllable's place in words of two or more: it begins, is inside, ends one, or stands alone.
BEGINS, INSIDE, ENDS, ALONE = 1, 2, 4, 8


def spans(syllables: Column, longest: int = LONGEST) -> Column:
    """struct(pos, len, gram) of every run of 2 to `longest` syllables."""
    empty = F.array().cast("array<struct<pos:int,len:int,gram:string>>")

    def every(s: Column) -> Column:
        one = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size(s) - n, F.lit(0))), lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), F.array_join(F.slice(s, i + 1, n), " ").alias("gram")))
        return F.concat(*[F.when(F.size(s) >= n, one(n)).otherwise(empty) for n in range(2, longest + 1)])

    return let(syllables, every)


class Dictionary:
    """Words of two or more syllables, and their beginnings, so that a search ends where no word goes on."""

    def __init__(self, words: dict[str, int]) -> None:
        self.words = {w: n for w, n in words.items() if " " in w}
        self.begun = {w[:i] for w in self.words for i, c in enumerate(w) if c == " "}

    def found(self, syllables: list[str], longest: int) -> Iterator[tuple[int, int, int]]:
        """(pos, len, n) of every word that stands in a sentence."""
        for i, gram in enumerate(syllables):
            for size, x in enumerate(syllables[i + 1 : i + longest], 2):
                if gram not in self.begun:
                    break
                gram = f"{gram} {x}"
                if gram in self.words:
                    yield i, size, self.words[gram]


def small_table(table: DataFrame, *texts: str, most: int = MOST, most_bytes: int = MOST_BYTES) -> pa.Table | None:
    """A table so small that the driver and each task may hold it; None if it is larger. It is made once."""
    held = table.persist(StorageLevel.DISK_ONLY)
    try:
        size = held.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(sum((F.octet_length(t) for t in texts), F.lit(0))), F.lit(0)).alias("bytes")).first()
        return held.toArrow() if size["n"] <= most and size["bytes"] <= most_bytes else None
    finally:
        held.unpersist()


#: The table that the last large lookup was split from, by application: it is on disk until the next one.
_split: dict[str, DataFrame] = {}


def parted(table: DataFrame, text: Column, most: int = MOST, most_bytes: int = MOST_BYTES) -> tuple[pa.Table | None, DataFrame | None]:
    """The rows of a table (..., n) with the largest n, so many that the driver and each task may hold them, and the others
    if there are any. The table is made once and stays on disk while there are others."""
    kept = table.persist(StorageLevel.DISK_ONLY)
    level = F.floor(F.log2(F.greatest(F.col("n"), F.lit(1)).cast("double")) * 16).cast("int")  # a thousand levels at most
    sizes = kept.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).orderBy(F.desc("level")).collect()
    fits, n, size = 0, 0, 0
    for r in sizes:
        n, size = n + r["n"], size + r["bytes"]
        if n > most or size > most_bytes:
            break
        fits += 1
    if fits == len(sizes):
        found = kept.toArrow()
        kept.unpersist()
        return found, None
    own = table.sparkSession.sparkContext.applicationId
    if own in _split:
        _split[own].unpersist()
    _split[own] = kept
    least = sizes[fits - 1]["level"] if fits else None
    return (kept.where(level >= least).toArrow(), kept.where(level < least)) if fits else (None, kept)


def _hashed(texts: pa.Array) -> np.ndarray:
    """A 64-bit hash of each text."""
    return np.array([int.from_bytes(hashlib.blake2b((x or "").encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in texts.to_pylist()], np.uint64)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of runs, from those without the last syllable and those of the last one."""
    h = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b
    return (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The elements of lists, their hashes, and the lists' sizes."""
    coded = lists.flatten().dictionary_encode()
    return coded, _hashed(coded.dictionary)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64), lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)


def _word_keys(rest: DataFrame, word: str) -> DataFrame:
    """key: the hash of each word."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            _, h, sizes = _flat(pc.split_pattern(batch.column(0), " "))
            starts = np.cumsum(sizes) - sizes
            out = h[starts] if len(starts) else h
            for i in range(1, int(sizes.max(initial=0))):
                at = np.flatnonzero(sizes > i)
                out[at] = _joined(out[at], h[starts[at] + i])
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], names=["key"])

    return rest.select(word).mapInArrow(run, "key long")


def _filter_of(rest: DataFrame, word: str = "word"):
    """A broadcast filter of the hashes of words, or None if it would be too large for one."""
    return filters.sharded(_word_keys(rest, word))


def candidates(sentences: DataFrame, key: str, syllables: str, longest: int, shared) -> DataFrame:
    """key, pos, len, gram: the runs of 2 to `longest` syllables that a filter lets through, or all."""
    if shared is None:
        return sentences.select(key, F.explode(spans(F.col(syllables), longest)).alias("s")).select(key, "s.*")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            keys, lists = batch.columns
            coded, h, sizes = _flat(lists)
            words, row = coded.dictionary, np.repeat(np.arange(len(sizes)), sizes)
            code = coded.indices.to_numpy()
            pos = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            left, run_hash = np.repeat(sizes, sizes) - pos, h
            for size in range(2, longest + 1):
                run_hash = _joined(run_hash[:-1], h[size - 1 :])
                at = np.flatnonzero(left[: len(run_hash)] >= size)
                at = at[shared.value.contains(run_hash[at])]
                if len(at):
                    gram = pc.binary_join_element_wise(*[words.take(pa.array(code[at + i])) for i in range(size)], " ")
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(row[at])), pa.array(pos[at], pa.int32()), pa.array(np.full(len(at), size), pa.int32()), gram], names=[key, "pos", "len", "gram"])

    kind = sentences.schema[key].dataType.simpleString()
    return sentences.select(key, syllables).mapInArrow(run, f"`{key}` {kind}, pos int, len int, gram string")


def _rest_found(sentences: DataFrame, rest: DataFrame, key: str, syllables: str, longest: int) -> DataFrame:
    """key, pos, len, n of the words of rest that stand in sentences."""
    rows = candidates(sentences, key, syllables, longest, _filter_of(rest))
    return rows.join(rest.select(F.col("word").alias("gram"), "n"), "gram").select(key, "pos", "len", "n")


def held(dictionary: DataFrame, most: int = MOST, longest: int = LONGEST):
    """A broadcast of a dictionary, or of its most frequent words; and a table of the others, or None."""
    rows = dictionary.select("word", F.col("n").cast("long").alias("n")).where(F.size(F.split("word", " ")).between(2, longest))
    top, rest = parted(rows, F.col("word"), most)
    top = Dictionary({} if top is None else dict(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True)))
    return dictionary.sparkSession.sparkContext.broadcast(top), rest


def _searched(sentences: DataFrame, dictionary: DataFrame, key: str, syllables: str, longest: int, most: int, of: Callable[[int, Iterator[tuple[int, int, int]]], list], returns, name: str) -> DataFrame:
    """key, syllables, and what is made of how many syllables a sentence has and of the words that stand in it."""
    shared, rest = held(dictionary, most, longest)
    if rest is None:
        each = _in_rows(lambda s: of(len(s), shared.value.found(s, longest)), returns)
        return sentences.select(key, syllables, each(F.col(syllables)).alias(name))
    more = _rest_found(sentences, rest, key, syllables, longest).groupBy(key).agg(F.collect_list(F.struct("pos", "len", "n")).alias("__sonca_more"))

    @F.pandas_udf(returns)
    def each(rows: pd.Series, more: pd.Series) -> pd.Series:
        both = lambda s, m: [*shared.value.found(s, longest), *((x["pos"], x["len"], x["n"]) for x in (() if m is None else m))]
        return pd.Series([None if s is None else of(len(s), both(list(s), m)) for s, m in zip(rows, more, strict=True)], dtype=object)

    return sentences.join(more, key, "left").select(key, syllables, each(F.col(syllables), F.col("__sonca_more")).alias(name))


def _in_rows(of, returns):
    """A UDF over arrays of syllables."""

    @F.pandas_udf(returns)
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else of(list(s)) for s in rows], dtype=object)

    return run


FOUND = ArrayType(StructType([StructField("pos", IntegerType()), StructField("len", IntegerType()), StructField("n", LongType())]))


def lattice(sentences: DataFrame, dictionary: DataFrame, key: str = "sent_id", syllables: str = "syllables", longest: int = LONGEST, most: int = MOST) -> DataFrame:
    """sent_id, pos, len, n: every dictionary word that stands in a sentence."""
    shared, rest = held(dictionary, most, longest)
    each = _in_rows(lambda s: [{"pos": p, "len": size, "n": n} for p, size, n in shared.value.found(s, longest)], FOUND)
    found = sentences.select(key, F.explode(each(F.col(syllables))).alias("w")).select(key, "w.*")
    return found if rest is None else found.unionByName(_rest_found(sentences, rest, key, syllables, longest))


def position_flags(found: DataFrame, key: str = "sent_id") -> DataFrame:
    """sent_id, pos, flags: the union of what each syllable is in the lattice's words."""
    at = F.explode(F.sequence(F.lit(0), F.col("len") - 1))
    rows = found.select(key, "pos", "len", at.alias("k"))
    flag = F.when(F.col("k") == 0, BEGINS).when(F.col("k") == F.col("len") - 1, ENDS).otherwise(INSIDE)
    return rows.groupBy(key, (F.col("pos") + F.col("k")).alias("pos")).agg(F.bit_or(flag).alias("flags"))


def flags_of(n: int, words: Iterator[tuple[int, int, int]]) -> list[int]:
    """What each syllable is in the words; 0 if in none."""
    out = [0] * n
    for pos, size, _ in words:
        out[pos] |= BEGINS
        out[pos + size - 1] |= ENDS
        for i in range(pos + 1, pos + size - 1):
            out[i] |= INSIDE
    return out


def flagged(sentences: DataFrame, dictionary: DataFrame, key: str = "sent_id", syllables: str = "syllables", longest: int = LONGEST, most: int = MOST) -> DataFrame:
    """`position_flags` of the lattice of sentences, whose keys are distinct."""
    found = _searched(sentences, dictionary, key, syllables, longest, most, flags_of, ArrayType(IntegerType()), "flags")
    return found.select(key, F.posexplode("flags").alias("pos", "flags")).where("flags <> 0")


def best_path(n: int, words: list[tuple[int, int, int]], penalty: float) -> list[str]:
    """Tags of n syllables on the best path: a word of l syllables adds 100 (l - 1) + log10 n, a single costs the penalty."""
    at: dict[int, list[tuple[int, float]]] = {}
    for pos, size, count in words:
        at.setdefault(pos + size, []).append((size, 100.0 * (size - 1) + math.log10(max(count, 1))))
    score, back = [0.0] * (n + 1), [1] * (n + 1)
    for i in range(1, n + 1):
        score[i] = score[i - 1] - penalty
        for size, gain in sorted(at.get(i, ())):
            if score[i - size] + gain > score[i]:
                score[i], back[i] = score[i - size] + gain, size
    out, i = ["B"] * n, n
    while i > 0:
        out[i - back[i] + 1 : i] = ["I"] * (back[i] - 1)
        i -= back[i]
    return out


def segmented(sentences: DataFrame, dictionary: DataFrame, key: str = "sent_id", syllables: str = "syllables", longest: int = LONGEST, penalty: float = 1.0, most: int = MOST) -> DataFrame:
    """sent_id, syllables, tags: B where a word begins, I inside it."""
    return _searched(sentences, dictionary, key, syllables, longest, most, lambda n, words: best_path(n, list(words), penalty), ArrayType(StringType()), "tags")


def greedy_path(n: int, words: Iterator[tuple[int, int, int]]) -> list[str]:
    """Tags of n syllables by the longest word from the left on."""
    at: dict[int, int] = {}
    for pos, size, _ in words:
        at[pos] = max(size, at.get(pos, 1))
    out, i = [], 0
    while i < n:
        size = at.get(i, 1)
        out += ["B", *["I"] * (size - 1)]
        i += size
    return out


def greedy(sentences: DataFrame, dictionary: DataFrame, key: str = "sent_id", syllables: str = "syllables", longest: int = LONGEST, most: int = MOST) -> DataFrame:
    """As `segmented`, by the longest word from the left on."""
    return _searched(sentences, dictionary, key, syllables, longest, most, greedy_path, ArrayType(StringType()), "tags")


def variants(vocabulary: DataFrame) -> DataFrame:
    """bare, variants: the renderings (vocab, n) that share a form without tone and mark, the most frequent first."""
    from ..functions.ids import without_tone_and_mark

    rows = vocabulary.select(without_tone_and_mark(F.col("vocab")).alias("bare"), "vocab", "n")
    return rows.groupBy("bare").agg(F.sort_array(F.collect_list(F.struct("n", "vocab")), asc=False).alias("variants"))


def gain(n: float) -> int:
    """log(1 + n) in millionths: sums of whole numbers are the same in any order."""
    return round(1e6 * math.log1p(n))


def restored_path(options: list[list[tuple[str, float]]], pairs: dict[tuple[str, str], float]) -> list[str]:
    """The best choice of one option each: the sum of log counts of choices and of pairs of neighbours.

    Of equal sums the path that is last in order wins. Each option keeps one step back and its path's place among the
    paths in order, so a sentence costs no more than its options and pairs of them.
    """
    if not options:
        return []
    best = [(gain(n), 0) for _, n in options[0]]  # score, place in order
    back, order = [], sorted(range(len(options[0])), key=lambda j: options[0][j][0])
    best = [(score, order.index(j)) for j, (score, _) in enumerate(best)]
    before = options[0]
    for here in options[1:]:
        steps = []
        for x, n in here:
            own = gain(n)
            steps.append(max((score + own + 2 * gain(pairs.get((before[j][0], x), 0)), place, j) for j, (score, place) in enumerate(best)))
        ranks = {k: i for i, k in enumerate(sorted((place, here[j][0]) for j, (_, place, _) in enumerate(steps)))}
        back.append([j for _, _, j in steps])
        best = [(score, ranks[place, here[j][0]]) for j, (score, place, _) in enumerate(steps)]
        before = here
    j = max(range(len(best)), key=lambda j: best[j])
    out = [options[-1][j][0]]
    for here, steps in zip(options[-2::-1], reversed(back), strict=True):
        j = steps[j]
        out.append(here[j][0])
    return out[::-1]


def restored(sentences: DataFrame, options_of: DataFrame, bigrams: DataFrame, key: str = "sent_id", syllables: str = "syllables", most: int = MOST, most_options: int | None = None) -> DataFrame:
    """sent_id, syllables, restored: bare syllables with the tones and marks of the most likely path.

    options_of is (bare, variants), as `variants` makes it; bigrams is (gram, n_count) over renderings. Where options and
    the pairs that decide between some fit a broadcast, each row is done by itself. Of more pairs the most frequent are
    held so, and a join brings a sentence the others that its own options make, as far as a filter of them lets them
    through. Options that are too large are joined too. A pair of two syllables without other options decides nothing.
    """
    # A syllable whose only form is itself needs no options.
    some = options_of.where((F.size("variants") > 1) | (F.col("variants")[0]["vocab"] != F.col("bare"))).select("bare", F.col("variants.vocab").alias("x"), F.col("variants.n").alias("n"), F.array_join("variants.vocab", "").alias("all"))
    options = small_table(some, "bare", "all", most=most if most_options is None else most_options)
    if options is None:
        return _restored_by_joins(sentences, options_of, bigrams, key, syllables)
    options = {b: [(x, float(n)) for x, n in zip(xs, ns, strict=True)] for b, xs, ns in zip(*(options[c].to_pylist() for c in ("bare", "x", "n")), strict=True)}
    several = sentences.sparkSession.createDataFrame(pa.table({"x": pa.array([x for o in options.values() if len(o) > 1 for x, _ in o], pa.string())}))
    pair = F.split("gram", " ")
    open_pairs = bigrams.select("gram", F.get(pair, 0).alias("a"), F.get(pair, 1).alias("b"), F.col("n_count").cast("long").alias("n"))
    for side in ("a", "b"):
        open_pairs = open_pairs.join(F.broadcast(several.select(F.col("x").alias(side), F.lit(True).alias(f"open_{side}"))), side, "left")
    top, rest = parted(open_pairs.where("open_a or open_b").select("gram", "n"), F.col("gram"), most)
    pairs = {} if top is None else {tuple(g.split(" ", 1)): float(n) for g, n in zip(top["gram"].to_pylist(), top["n"].to_pylist(), strict=True)}
    shared = sentences.sparkSession.sparkContext.broadcast((options, pairs))
    if rest is None:
        each = _in_rows(lambda s: restored_path([shared.value[0].get(x) or [(x, 0.0)] for x in s], shared.value[1]), ArrayType(StringType()))
        return sentences.select(key, syllables, each(F.col(syllables)).alias("restored"))
    asked = _open_pairs(sentences, key, syllables, shared, _filter_of(rest, "gram"))
    more = asked.join(rest, "gram").groupBy(key).agg(F.collect_list(F.struct("gram", "n")).alias("__sonca_more"))

    @F.pandas_udf(ArrayType(StringType()))
    def path(rows: pd.Series, more: pd.Series) -> pd.Series:
        def one(s, m) -> list[str]:
            found = _Both(shared.value[1], {} if m is None else {tuple(x["gram"].split(" ", 1)): float(x["n"]) for x in m})
            return restored_path([shared.value[0].get(x) or [(x, 0.0)] for x in s], found)

        return pd.Series([None if s is None else one(list(s), m) for s, m in zip(rows, more, strict=True)], dtype=object)

    return sentences.join(more, key, "left").select(key, syllables, path(F.col(syllables), F.col("__sonca_more")).alias("restored"))


class _Both:
    """Counts of pairs: those that all tasks hold, and those of a sentence."""

    def __init__(self, held: dict, own: dict) -> None:
        self.held, self.own = held, own

    def get(self, pair, default):
        return self.held.get(pair) or self.own.get(pair, default)


def _open_pairs(sentences: DataFrame, key: str, syllables: str, shared, among) -> DataFrame:
    """key, gram: the pairs of neighbours' options that decide something and are not held, if a filter lets them through."""
    kind = sentences.schema[key].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options, pairs = shared.value
        names = {x: [v for v, _ in o] for x, o in options.items()}
        for batch in stream:
            for first in range(0, batch.num_rows, 512):  # what is asked about stays small
                keys, rows = (c.slice(first, 512) for c in batch.columns)
                asked: dict[tuple[int, str, str], None] = {}
                for i, s in enumerate(rows.to_pylist()):
                    held = [names.get(x) or [x] for x in s or ()]
                    for us, vs in zip(held, held[1:]):
                        if len(us) > 1 or len(vs) > 1:
                            asked.update(((i, u, v), None) for u in us for v in vs if (u, v) not in pairs)
                if asked:
                    at, us, vs = zip(*asked, strict=True)
                    a, b = (pa.array(x, pa.string()) for x in (us, vs))
                    good = np.ones(len(at), bool)
                    if among is not None:
                        ha, hb = ((lambda c: _hashed(c.dictionary)[c.indices.to_numpy()])(x.dictionary_encode()) for x in (a, b))
                        good = among.value.contains(_joined(ha, hb))
                    gram = pc.binary_join_element_wise(a, b, " ").filter(pa.array(good))
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.array(at)[good])), gram], names=[key, "gram"])

    return sentences.select(key, syllables).mapInArrow(run, f"`{key}` {kind}, gram string")


def _restored_by_joins(sentences: DataFrame, options_of: DataFrame, bigrams: DataFrame, key: str, syllables: str) -> DataFrame:
    at = sentences.select(key, F.posexplode(syllables).alias("pos", "bare")).join(options_of, "bare", "left")
    options = F.coalesce(F.transform("variants", lambda v: F.struct(v["vocab"].alias("x"), v["n"].cast("double").alias("n"))), F.array(F.struct(F.col("bare").alias("x"), F.lit(0.0).alias("n"))))
    held = at.select(key, F.struct("pos", options.alias("o")).alias("p")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["o"]).alias("options"))
    none = F.array().cast("array<struct<o:array<struct<x:string,n:double>>>>")
    near = held.select(key, F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size("options") - 1, F.lit(1))), lambda i: F.coalesce(F.flatten(F.transform(F.get("options", i - 1), lambda a: F.transform(F.get("options", i), lambda b: F.concat_ws(" ", a["x"], b["x"])))), F.array().cast("array<string>"))))).alias("gram")).distinct()
    pairs = near.join(bigrams.select("gram", "n_count"), "gram").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("gram", F.col("n_count").cast("double")))).alias("pairs"))

    @F.pandas_udf(ArrayType(StringType()))
    def path(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for options, pairs in parts:
            yield pd.Series([restored_path([[(v["x"], v["n"]) for v in o["o"]] for o in os], {tuple(g.split(" ", 1)): n for g, n in (dict(ps) if ps is not None else {}).items()}) for os, ps in zip(options, pairs, strict=True)])

    return sentences.join(held, key, "left").join(pairs, key, "left").select(key, syllables, path(F.coalesce(F.transform("options", lambda o: F.struct(o.alias("o"))), none), "pairs").alias("restored"))
