"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Features are words and marks, their first 4, 5 and 6 characters, and pairs of neighbours, hashed into BUCKETS. The target
model counts labelled rows of good quality that are not toxic (a hash sample of about LABELLED labelled rows at most).
The raw model counts all rows, each language weighted by its share in the target, so that the two differ in kind of text
and not in language. Each ratio p_target / p_raw is shrunk by PRIOR counts, and log ratios within NOISE count as none:
the raw text is for the most part target text, so that the small ratios of common words, of which there are many, would
hide the few words that set a text apart. A row's weight is the mean of the log ratios over its n-grams, so that long and
short texts compete on equal terms: LENGTH times it is the log of the importance weight of a text of LENGTH n-grams.

Rows are drawn without replacement by Gumbel top-k: key = LENGTH * weight + Gumbel(hash of the row), and the rows with
the k largest keys are kept. k is the wanted share of all rows that have words. The share is a parameter; it is the
target's share among all labelled rows if not given. Nothing else of the labels takes part in the choice. The k-th key is
found by radix selection, four narrow aggregations; no row is sorted or sent to the driver.

Null text and text without words are rejected. Without labels of both kinds nothing is known and all other rows are
kept. Repeated rows have the same key; rows that tie at the k-th key are all kept. A doc_id labelled twice takes the
worse label. The LANGS languages with the most rows (ties go to the first in order) are weighted each by itself, all
others and rows without a language together, so counts stay bounded whatever stands in the language column. Columns
other than the key, the text and the language are carried along untouched by `selected`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS, CHUNK, LABELLED, PRIOR, NOISE, LENGTH, LANGS, SALT, MOST = 1 << 18, 1 << 13, 20_000, 4.0, 0.4, 1000.0, 31, 23, 1_000_000
PREFIXES, KNOWN = (4, 5, 6), 300_000
_TOKENS = re.compile(r"\w+|[^\w\s]+").findall
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


class Words:
    """Buckets of words, kept for reuse; emptied when full, which costs time and never results."""

    def __init__(self) -> None:
        self.known, self.hashes, self.buckets = {}, np.zeros(1 << 16, np.uint64), np.zeros((1 << 16, 1 + len(PREFIXES)), np.int64)

    def ids(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new and len(self.known) + len(new) > KNOWN:
            self.known, new = {}, list(dict.fromkeys(words))
        if new:
            n = len(self.known)
            while n + len(new) > len(self.hashes):
                self.hashes, self.buckets = np.concatenate([self.hashes, self.hashes]), np.concatenate([self.buckets, self.buckets])
            crc = np.array([[zlib.crc32(w.encode("utf-8", "surrogatepass")), *(zlib.crc32(f"^{p}{w[:p]}".encode("utf-8", "surrogatepass")) for p in PREFIXES)] for w in new], np.uint64)
            self.hashes[n : n + len(new)] = crc[:, 0]
            self.buckets[n : n + len(new)] = common.mix(crc + np.uint64(1)) >> _SHIFT
            self.known.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


_words = Words()


def features(text: str) -> np.ndarray:
    """Buckets of all n-grams of a text."""
    ids = _words.ids(_TOKENS(text.lower()))
    h = _words.hashes[ids]
    pairs = common.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) >> _SHIFT
    return np.concatenate([_words.buckets[ids].ravel(), pairs.astype(np.int64)])


def ratios(target: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """By bucket, log of target counts over what the raw model expects of as many n-grams; noise is none."""
    out = np.log(target + PRIOR) - np.log(expected + PRIOR)
    return np.where(np.abs(out) < NOISE, 0.0, out).astype(np.float32)


def judged_labels(labels: DataFrame) -> DataFrame:
    """id, good: one row for each labelled key."""
    rows = labels.groupBy(labels["doc_id"].cast("long").alias("id")).agg(((F.min("quality") == 1) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)).alias("good"))
    return rows.where("id is not null and good is not null")


def sampled(judged: DataFrame, n: int, most: int = LABELLED) -> DataFrame:
    """id of the good ones in a hash sample of n judged keys, about `most` at most."""
    h = F.pmod(F.xxhash64("id", F.lit(SALT)), F.lit(3 << 20))
    return judged.where((h < int((3 << 20) * min(1.0, most / n))) & F.col("good")).select("id") if n else judged.where(F.lit(False)).select("id")


VECTORS = pa.schema([("kind", pa.string()), ("chunk", pa.int32()), ("total", pa.float64()), ("counts", pa.binary())])
VECTORS_SQL = "kind string, chunk int, total double, counts binary"


def _vectors(held: dict[tuple[str, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    rows = ((kind, c, float(x.sum()), x.tobytes()) for (kind, c), x in held.items() if x.any())
    yield from common.batches(VECTORS, rows, 64)


def _count(langs: dict[str, int]):
    """mapInArrow: texts to count vectors in chunks, one for each kind (r, or t for the target, and the language) and task."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in stream:
            found: dict[str, list[np.ndarray]] = {}
            for t, lang, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t:
                    f = features(t)
                    for kind in ("r", "t") if target else ("r",):
                        found.setdefault(f"{kind}{langs.get(lang, len(langs))}", []).append(f)
            for kind, fs in found.items():
                held[kind] = held.get(kind, 0) + np.bincount(np.concatenate(fs), minlength=BUCKETS).astype(np.float64)
        yield from _vectors({(k, c): x[c * CHUNK : (c + 1) * CHUNK] for k, x in held.items() for c in range(BUCKETS // CHUNK)})

    return run


def _summed(vectors: DataFrame, scale: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """Sums of the vectors of a kind and chunk; with scale, of the kinds it renames, each times its factor."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for batch in stream:
            for kind, chunk, _, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                to, factor = (kind, 1.0) if scale is None else scale[kind]
                held[to, chunk] = held.get((to, chunk), 0) + np.frombuffer(counts) * factor
        yield from _vectors(held)

    return vectors.repartition("kind", "chunk").mapInArrow(run, VECTORS_SQL) if scale is None else vectors.repartition("chunk").mapInArrow(run, VECTORS_SQL)


def fit(docs: DataFrame, target: DataFrame, scratch: common.Scratch, key: str = "doc_id", text: str = "text", lang: str = "lang", langs: int = LANGS) -> np.ndarray:
    """The log ratio of each bucket; only sums over languages reach the driver."""
    rows = docs.select(docs[key].cast("long").alias("id"), docs[text].cast("string").alias("text"), docs[lang].cast("string").alias("lang"))
    own = {r["lang"]: i for i, r in enumerate(rows.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(langs).collect())}
    marked = rows.join(F.broadcast(target.select("id", F.lit(True).alias("target"))), "id", "left").select("text", "lang", F.coalesce("target", F.lit(False)).alias("target"))
    sums = scratch.keep(_summed(marked.mapInArrow(_count(own), VECTORS_SQL)), "counts")
    totals = {r["kind"]: r["n"] for r in sums.groupBy("kind").agg(F.sum("total").alias("n")).collect()}  # two for each language
    scale = {k: ("t", 1.0) if k[0] == "t" else ("r", totals.get("t" + k[1:], 0.0) / n) for k, n in totals.items()}
    out = {"r": np.zeros(BUCKETS), "t": np.zeros(BUCKETS)}
    for r in _summed(sums, scale).collect():
        out[r["kind"]][r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"])
    return ratios(out["t"], out["r"])


def ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as longs of the same order."""
    b = x.view(np.int64)
    return b ^ ((b >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def scored(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), n_ngrams, weight, rank (the Gumbel key as a long) of each row; null without words."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_ngrams", pa.int64()), ("weight", pa.float64()), ("rank", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in stream:
            if not batch.num_rows:
                continue
            n, s = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for i, t in enumerate(batch.column(3).to_pylist()):
                if t and len(f := features(t)):
                    n[i], s[i] = len(f), w[f].sum(dtype=np.float64) / len(f)
            u = (batch.column(2).to_numpy().view(np.uint64) >> np.uint64(11)).astype(np.float64)
            gumbel = -np.log(-np.log((u + 0.5) / (1 << 53)))
            none = n == 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(s, mask=none), pa.array(ordered(LENGTH * s + gumbel), mask=none)], schema=schema)

    k, t = docs[key].cast("long"), docs[text].cast("string")
    return docs.select(k.alias("doc_id"), F.xxhash64(t).alias("th"), F.xxhash64(k, t, F.lit(SALT)).alias("u"), t.alias("text")).mapInArrow(run, "doc_id long, th long, n_ngrams long, weight double, rank long")


def kth_largest(ranks: DataFrame, k: int) -> int:
    """The k-th largest long of a column `rank`, by 16 bits at a time from the top."""
    prefix, left = None, k
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("rank", shift)
        rows = ranks if prefix is None else ranks.where(F.shiftright("rank", shift + 16) == prefix)
        for r in sorted(rows.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["d"]):
            if r["n"] >= left:
                prefix = r["d"]
                break
            left -= r["n"]
    return prefix


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", share: float | None = None) -> DataFrame:
    """doc_id, th, n_ngrams, weight, kept for each row; written in the shared folder. share: of the rows with words."""
    scratch = common.Scratch(docs.sparkSession, "quality")
    judged = scratch.keep(judged_labels(labels), "labels")
    seen = judged.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("good").cast("int")), F.lit(0)).alias("good")).first()
    held = scratch.keep(scored(docs, fit(docs, scratch.keep(sampled(judged, seen["n"]), "target"), scratch, key, text, lang), key, text), "scored")
    if share is None:
        share = seen["good"] / seen["n"] if 0 < seen["good"] < seen["n"] else 1.0
    ranks = held.where("rank is not null")
    k = round(share * ranks.count())
    kept = F.coalesce(F.col("rank") >= F.lit(kth_largest(ranks, k)), F.lit(False)) if k else F.lit(False)
    return held.select("doc_id", "th", "n_ngrams", "weight", kept.alias("kept"))


def selected(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    bad = common.Scratch(docs.sparkSession, "quality").keep(classify(docs, labels, key, text, lang).where("not kept").select(F.coalesce("doc_id", F.lit(-1)).alias("__sonca_key"), "th").distinct().withColumnRenamed("th", "__sonca_th"), "rejected")
    side = F.broadcast(bad) if bad.count() <= MOST else bad
    return docs.join(side, (F.coalesce(docs[key].cast("long"), F.lit(-1)) == side["__sonca_key"]) & (F.xxhash64(docs[text].cast("string")) == side["__sonca_th"]), "left_anti")
