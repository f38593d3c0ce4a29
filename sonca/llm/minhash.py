"""Near-duplicates: MinHash bands, sequential Bayesian verification of signatures, exact verification of survivors.

1. One pass over the texts makes, for each row, the size of its set of word shingles, a digest of its word sequence, its
   signature and its band keys. Rows with equal word sequences are one class, whose representative is the smallest key:
   copies are never paired.
2. Representatives that share a band key are candidates. In each band bucket all are paired with its smallest key, a
   star, not with each other. Signatures of a pair are compared batch by batch; with a uniform prior the posterior of the
   similarity s after m matches of n is Beta(m + 1, n - m + 1), and a pair is pruned once P(s >= threshold) < MISS.
3. Survivors are verified on their full shingle sets: links are exact.
4. Links become components by repeated minima over neighbours with pointer jumping, in tables of the shared folder.
5. Members that share a smallest key but not its component are gone over again: each that is not linked with that key
   is held against the others of different components, in blocks of bounded size with an index of their shingles, so
   that no pairs are formed but those that link two components. Both those that are held against others and the others
   are dealt into blocks; each two blocks of a group meet in a task of their own. Linked members are left out if a triangle of Jaccard
   distances rules the link out, that is if the other is surely further than twice the allowed distance from the key.

With 32 bands of 5 rows a pair at similarity 0.8 shares no band with probability (1 - 0.8**5)**32 = 3e-6.

Null text and text without words have an empty set, link with nothing and are kept. Fewer words than a shingle make one
shingle of them all. Rows that repeat a key and its words share a component; where a key stands on rows of different
words each of them is judged by its own. component_id is the smallest key of a component, so two components may bear one
number if their smallest keys are rows of the same key. A null key is a component of its own.

Nodes of the graph are 24 bytes: the key, in the order of numbers, and the digest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from . import common

SHINGLE, PERCENT, BANDS, ROWS, STEP, MISS, MOST = 5, 80, 32, 5, 16, 1e-6, 1_000_000
#: Shingles of a block: where a group has up to SHARES blocks, and at most.
LEAST, BLOCK, SHARES = 16_000, 2_000_000, 8
SIZE = BANDS * ROWS
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, SIZE, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, SIZE, dtype=np.uint64)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text: bytes, n: int) -> tuple[np.ndarray, bytes]:
    """The sorted distinct shingle hashes of a text, and the digest of its word sequence."""
    words = text.translate(_LOWER).split()
    digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    if not words:
        return np.zeros(0, np.uint64), digest
    hashes = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    return np.unique(common.grams(hashes, min(n, len(words)))), digest


def signature(s: np.ndarray) -> np.ndarray:
    """SIZE minima of the set under multiply-add hashes, in blocks of bounded memory."""
    out = np.full(SIZE, 0xFFFFFFFF, np.uint64)
    for a in range(0, len(s), 512):
        part = (s[a : a + 512, None] * _A + _B) >> np.uint64(32)
        np.minimum(out, part.min(0), out=out)
    return out.astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows, out = sig.reshape(BANDS, ROWS).astype(np.uint64), np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        out = common.mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return out.view(np.int64)


def _above(m: int, n: int, t: float) -> float:
    """P(s >= t) for Beta(m + 1, n - m + 1): the chance of at most m successes in n + 1 at rate t."""
    return sum(math.comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1))


@lru_cache(maxsize=8)
def least_matches(t: float, miss: float) -> tuple[int, ...]:
    """For n = STEP, 2 STEP ...: the fewest matches with which a pair isn't pruned."""
    return tuple(next((m for m in range(n + 1) if _above(m, n, t) >= miss), n + 1) for n in range(STEP, SIZE + 1, STEP))


def verdicts(a: np.ndarray, b: np.ndarray, t: float, miss: float = MISS) -> np.ndarray:
    """By pair of signatures (rows), whether it survives all batches; a pruned pair is compared no further."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, least in enumerate(least_matches(t, miss)):
        part = slice(i * STEP, (i + 1) * STEP)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(1)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def node_of(key: int | None, digest: bytes) -> bytes | None:
    """A key and a digest as bytes that sort by the key; null without a key."""
    return None if key is None else (key + (1 << 63)).to_bytes(8, "big") + digest


def _key(node: Column) -> Column:
    """The key of a node."""
    number = F.conv(F.hex(F.substring(node, 1, 8)), 16, 10).cast("decimal(20,0)")
    return (number - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def profiles(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """doc_id, n_shingles, digest, node, sig, bands of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("node", pa.binary()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def each(batch: pa.RecordBatch) -> Iterator[tuple]:
        for k, t in zip(batch.column(0).to_pylist(), common.utf8(batch.column(1)), strict=True):
            s, digest = shingles(t, n)
            if len(s):
                sig = signature(s)
                yield k, len(s), digest, node_of(k, digest), sig.tobytes(), band_keys(sig)
            else:
                yield k, 0, digest, node_of(k, digest), None, None

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(common.by_rows(schema, each), "doc_id long, n_shingles long, digest binary, node binary, sig binary, bands array<long>")


def _survivors(pairs: DataFrame, reps: DataFrame, t: float) -> DataFrame:
    """The pairs (a, b) whose signatures are not pruned at similarity t; far: pruned at the triangle's similarity too."""
    near = max(0.0, 2 * t - 1)
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("alive", pa.bool_()), ("far", pa.bool_())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in stream:
            if x.num_rows:
                a, b = (np.frombuffer(b"".join(x.column(i).to_pylist()), np.uint32).reshape(-1, SIZE) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(verdicts(a, b, t)), pa.array(~verdicts(a, b, near))], schema=schema)

    sigs = reps.select("node", "sig")
    joined = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary, alive boolean, far boolean")


def _sets(ids: DataFrame, docs: DataFrame, scratch: common.Scratch, tag: str, key: str, text: str, n: int) -> DataFrame:
    """id, set: the full shingle sets of the given nodes, written; only the texts of their keys are read again."""
    ids = scratch.keep(ids.distinct(), f"ids{tag}")
    side = _small(ids)
    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text")).join(side.select(_key(F.col("id")).alias("key")), "key", "left_semi")

    def sets(batch: pa.RecordBatch) -> Iterator[tuple]:
        for k, t in zip(batch.column(0).to_pylist(), common.utf8(batch.column(1)), strict=True):
            s, digest = shingles(t, n)
            yield node_of(k, digest), s.tobytes()

    held = rows.mapInArrow(common.by_rows(pa.schema([("id", pa.binary()), ("set", pa.binary())]), sets), "id binary, set binary").join(side, "id", "left_semi").dropDuplicates(["id"])
    return scratch.keep(held, f"sets{tag}")


def _linked(pairs: DataFrame, docs: DataFrame, scratch: common.Scratch, key: str, text: str, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    held = _sets(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), docs, scratch, "1", key, text, n)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
        for x in stream:
            a, b = ([np.frombuffer(v, np.uint64) for v in x.column(i).to_pylist()] for i in (2, 3))
            both = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(a, b, strict=True)], np.int64)
            union = np.array([len(p) + len(q) for p, q in zip(a, b, strict=True)], np.int64) - both
            good = pa.array(100 * both >= percent * union, pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column(0).filter(good), x.column(1).filter(good)], schema=schema)

    joined = pairs.select("a", "b").join(held.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(held.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    out = scratch.keep(joined.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary"), "links1")
    scratch.drop("sets1", "ids1")
    return out


class _Block:
    """Shingle sets of some members of a group, indexed by shingle."""

    def __init__(self, members: list[tuple]) -> None:
        ids, comps, links, _, sets = zip(*(m[4:] for m in members), strict=True)
        self.ids, self.codes, self.links = ids, {c: i for i, c in enumerate(dict.fromkeys(comps))}, np.array(links)
        self.comps = np.array([self.codes[c] for c in comps])
        arrays = [np.frombuffer(x, np.uint64) for x in sets]
        self.sizes = np.array([len(x) for x in arrays])
        flat, owner = np.concatenate(arrays), np.repeat(np.arange(len(arrays)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]

    def linked(self, node: bytes, comp: bytes, far: bool, shingle_set: bytes, percent: int) -> Iterator[tuple[bytes, bytes]]:
        """One link of the set to each other component that it is similar to."""
        x = np.frombuffer(shingle_set, np.uint64)
        a, b = np.searchsorted(self.flat, x, "left"), np.searchsorted(self.flat, x, "right")
        n = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(self.owner[at], minlength=len(self.ids))
        good = (100 * both >= percent * (self.sizes + len(x) - both)) & (self.comps != self.codes.get(comp, -1)) & ~(self.links & far)
        _, first = np.unique(self.comps[good], return_index=True)
        for i in np.flatnonzero(good)[first].tolist():
            yield min(self.ids[i], node), max(self.ids[i], node)


def _small(table: DataFrame) -> DataFrame:
    """A written table as a broadcast if it has at most MOST rows, of a few bytes each."""
    return F.broadcast(table) if table.count() <= MOST else table


def _blocks(shingles: Column) -> Column:
    """How many blocks a group of so many shingles is dealt into: small ones while these are few, then larger ones."""
    return F.greatest(F.lit(1), F.least(F.ceil(shingles / LEAST), F.greatest(F.lit(SHARES), F.ceil(shingles / BLOCK)))).cast("int")


def _across(star: DataFrame, comp: DataFrame, rows: DataFrame, docs: DataFrame, scratch: common.Scratch, key: str, text: str, n: int, percent: int) -> DataFrame:
    """Links between components among the members of a star: head, id, link, far."""
    of = comp.select(F.col("node"), F.col("comp"))
    tagged = star.join(of.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    tagged = tagged.join(rows.select(F.col("node").alias("id"), "n_shingles").groupBy("id").agg(F.max("n_shingles").alias("n")), "id")
    # A head may be that of a third of all rows, so its own rows are not dealt by it: what is known of heads is joined as
    # a broadcast of checked size; more of them are joined by Spark, which splits a head that is too frequent.
    known = star.select("head").distinct().join(of.select(F.col("node").alias("head"), F.col("comp").alias("own")), "head", "left")
    tagged = tagged.join(_small(scratch.keep(known.select("head", F.coalesce("own", "head").alias("own")), "heads")), "head")
    tagged = scratch.keep(tagged.withColumn("query", ~F.col("link") & (F.col("comp") != F.col("own"))), "tagged")
    heads = tagged.groupBy("head").agg(_blocks(F.sum("n")).alias("blocks"), _blocks(F.sum(F.when(F.col("query"), F.col("n")).otherwise(0))).alias("slices"), F.max(F.col("query").cast("int")).alias("open"), F.count(F.lit(1)).alias("members")).where("open = 1 and members > 1").select("head", "blocks", "slices")
    rest = scratch.keep(tagged.join(_small(scratch.keep(heads, "open")), "head").select("head", "blocks", "slices", "id", "comp", "link", "far", "query"), "rest")
    held = _sets(rest.select("id"), docs, scratch, "2", key, text, n)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    target = rest.withColumn("block", own("blocks", 1)).withColumn("slice", every("slices")).withColumn("asks", F.lit(0))
    asking = rest.where("query").withColumn("slice", own("slices", 2)).withColumn("block", every("blocks")).withColumn("asks", F.lit(1))
    cols = ["head", "block", "slice", "asks", "id", "comp", "link", "far"]
    both = target.select(*cols).unionByName(asking.select(*cols)).join(held, "id").select(*cols, "set")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, block = None, [], None

        def links(batch: pa.RecordBatch) -> Iterator[tuple]:
            nonlocal group, members, block
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != group:
                    group, members, block = row[:3], [], None
                if row[3] == 0:
                    members.append(row)
                    continue
                if block is None:
                    block, members = _Block(members) if members else None, []
                if block is not None:
                    yield from block.linked(row[4], row[5], row[7], row[8], percent)

        for batch in stream:
            if batch.num_rows:
                yield from common.batches(pa.schema([("a", pa.binary()), ("b", pa.binary())]), links(batch))

    out = both.repartition("head", "block", "slice").sortWithinPartitions("head", "block", "slice", "asks").mapInArrow(run, "a binary, b binary")
    return scratch.keep(out, "links2")


def components(links: DataFrame, scratch: common.Scratch, tag: str) -> DataFrame:
    """node, comp: the smallest node reachable, for each node of a link.

    Each round takes minima over neighbours and then the label of the label, until nothing changes.
    """
    both = scratch.keep(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct().toDF("node", "other"), f"both{tag}")
    label, i = scratch.keep(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("comp")), f"cc{tag}0"), 0
    while True:
        i += 1
        of = label.select(F.col("node").alias("other"), F.col("comp").alias("theirs"))
        least = both.join(of, "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        step = label.join(least, "node").select("node", F.least("comp", "theirs").alias("next"), "comp")
        jump = label.select(F.col("node").alias("next"), F.col("comp").alias("beyond"))
        after = step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("beyond", "next")).alias("comp"), F.col("comp").alias("before"))
        after = scratch.keep(after, f"cc{tag}{i}")
        done = after.where("comp <> before").isEmpty()
        scratch.drop(f"cc{tag}{i - 1}")
        label = after.select("node", "comp")
        if done:
            scratch.drop(f"both{tag}")
            return label


def _judged(docs: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, node for each row."""
    spark, scratch, t = docs.sparkSession, common.Scratch(docs.sparkSession, "minhash"), percent / 100
    rows = scratch.keep(profiles(docs, key, text, shingle), "profiles")
    classes = scratch.keep(rows.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("node").alias("rep")), "classes")
    reps = scratch.keep(rows.where("doc_id is not null").join(classes.select(F.col("rep").alias("node")), "node", "left_semi").dropDuplicates(["node"]).select("node", "sig", "bands"), "reps")
    members = reps.select("node", F.explode("bands").alias("band"))
    buckets = scratch.keep(members.groupBy("band").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").select("band", "head"), "buckets")
    stars = members.join(buckets, "band").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    judged = scratch.keep(_survivors(stars, reps, t), "judged")
    links = _linked(judged.where("alive"), docs, scratch, key, text, shingle, percent)
    comp = components(links, scratch, "1")

    star = judged.join(links.withColumn("link", F.lit(True)), ["a", "b"], "left").select(F.col("a").alias("head"), F.col("b").alias("id"), F.coalesce("link", F.lit(False)).alias("link"), "far")
    more = _across(star, comp, rows, docs, scratch, key, text, shingle, percent)
    if not more.isEmpty():
        comp = components(links.unionByName(more), scratch, "2")
    final = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("digest", _key(F.coalesce("comp", "rep")).alias("component"))
    out = rows.select("doc_id", "n_shingles", "digest", "node").join(final, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "node")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    return _judged(docs, key, text, shingle, percent).drop("node")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component: that with the smallest key.

    Where a key stands on kept rows and on others, its rows go by their words; texts are read again for such keys only.
    """
    scratch = common.Scratch(docs.sparkSession, "minhash")
    found = scratch.keep(_judged(docs, key, text, shingle, percent).where("doc_id is not null").select("doc_id", "node", "kept"), "found")
    keys = scratch.keep(found.groupBy("doc_id").agg(F.bool_or("kept").alias("some"), F.bool_and("kept").alias("every")).where("not every").select(F.col("doc_id").alias("__sonca_key"), "some"), "gone")
    gone, mixed = (_small(keys.where(c).select("__sonca_key")) for c in ("not some", "some"))
    left = docs.join(gone, docs[key].cast("long") == gone["__sonca_key"], "left_anti")
    if mixed.isEmpty():
        return left
    digest = F.substring("node", 9, 16).alias("__sonca_digest")
    nodes = scratch.keep(found.where("not kept").join(mixed, found["doc_id"] == mixed["__sonca_key"], "left_semi").select(F.col("doc_id").alias("__sonca_key"), digest).distinct(), "nodes")

    @F.pandas_udf(BinaryType())
    def digests(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles((t or "").encode(), shingle)[1] for t in texts], dtype=object)

    flagged = left.join(mixed, left[key].cast("long") == mixed["__sonca_key"], "left")
    own = flagged.withColumn("__sonca_digest", digests(F.when(F.col("__sonca_key").isNotNull(), F.col(text).cast("string"))))
    return own.join(_small(nodes), ["__sonca_key", "__sonca_digest"], "left_anti").select(*docs.columns)
