"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model learns from a hash sample of the rows that are not held out: each language's expected sample is at most
`per_lang` rows, chosen by a hash of the key, so no text is shuffled. The `max_langs` languages with the most rows are
learned (ties go to the first in order), which bounds the model. Counts by language and bucket are summed by Spark; the
matrix of log probabilities (buckets x languages) is broadcast with the scorer. A batch of texts is a sparse matrix of
bucket counts, multiplied with the model's in numpy, some languages at a time.

Null text, or text without any letter: `und`, score 0. No learned language at all: `und` for every row. Ties go to the
language first in order. Repeated rows give repeated results. Whole texts count, however long: they are read in pieces
that overlap, so that no n-gram is lost or made up at an edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS, SIZES, ALPHA, PER_LANG, MAX_LANGS = 1 << 15, (1, 2, 3), 0.1, 4000, 512
#: Characters that are counted at a time; numbers that a product of a batch may hold.
PIECE, HELD = 1 << 20, 1 << 22
SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


def hashed(x: np.ndarray, starts: int, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the n-grams of code points that begin at the first `starts` of them."""
    out, h = [], np.zeros(len(x), np.uint32)
    for n in range(1, max(SIZES) + 1):
        m = len(x) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ x[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in SIZES:
            out.append((h[:starts] * np.uint32(0x85EBCA77)) >> np.uint32(32 - buckets.bit_length() + 1))
    return np.concatenate(out)


def counted(text: str, piece: int = PIECE) -> np.ndarray:
    """By bucket, the n-grams of the lower-cased text between two spaces; pieces overlap by what an n-gram needs."""
    text, out = f" {text.lower()} ", 0
    for a in range(0, len(text), piece):
        x = np.frombuffer(text[a : a + piece + max(SIZES) - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        out = out + np.bincount(hashed(x, piece), minlength=BUCKETS)
    return out


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 4 == 2


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG, max_langs: int = MAX_LANGS) -> tuple[list[str], np.ndarray]:
    """The languages in order, and log probabilities: a row for each bucket, the last row the priors."""
    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].cast("string").alias("text"), docs[lang].cast("string").alias("lang")).where(F.col("lang").isNotNull() & ~held_out(F.col("k")))
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    if not totals:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    share = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, min(1.0, per_lang / n))])
    sample = rows.where(F.col("lang").isin(*totals)).where(F.pmod(F.xxhash64("k", F.lit(17)), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in stream:
            for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t:
                    held[g] = held.get(g, 0) + counted(t)
        for g, x in held.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(x[at], pa.int64())], schema=COUNTS)

    got = sample.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(totals)
    at = {g: i for i, g in enumerate(langs)}
    counts = np.zeros((BUCKETS, len(langs)))
    np.add.at(counts, (got["bucket"].to_numpy(), np.array([at[g] for g in got["lang"].to_pylist()], int)), got["n"].to_numpy())
    log = np.log(counts + ALPHA) - np.log(counts.sum(0) + ALPHA * BUCKETS)
    prior = np.log(np.array([totals[g] for g in langs], float) / sum(totals.values()))
    return langs, np.vstack([log, prior]).astype(np.float32)


def log_scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Joint log probabilities, a row for each text and a column for each language."""
    out = np.zeros((len(texts), weights.shape[1]))
    at, n, part = [], [], 0
    for i, t in enumerate(texts):
        counts = counted(t)
        at.append(np.flatnonzero(counts))
        n.append(counts[at[-1]].astype(np.float64))
        if i + 1 == len(texts) or (i + 1 - part) * BUCKETS > HELD:  # rows of the sparse matrix up to here
            cuts = np.cumsum([0, *map(len, at[:-1])])  # a text has at least its two spaces, so no row is empty
            places, values = np.concatenate(at), np.concatenate(n)
            wide = max(1, HELD // len(places))
            for a in range(0, weights.shape[1], wide):
                out[part : i + 1, a : a + wide] = np.add.reduceat(weights[places, a : a + wide].astype(np.float64) * values[:, None], cuts, axis=0)
            at, n, part = [], [], i + 1
    return out + weights[-1]


def predict(texts: list[str | None], langs: list[str], weights: np.ndarray) -> list[tuple[str, float]]:
    """(language, probability) of each text."""
    out = [("und", 0.0)] * len(texts)
    known = [i for i, t in enumerate(texts) if langs and t and any(map(str.isalpha, t))]
    if known:
        s = log_scores([texts[i] for i in known], weights)
        best = s.argmax(1)
        score = 1 / np.exp(s - s[np.arange(len(s)), best][:, None]).sum(1)
        for i, b, p in zip(known, best.tolist(), score.tolist(), strict=True):
            out[i] = langs[b], p
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; the matrix is a broadcast of bounded size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch) -> Iterator[tuple]:
        k, h, texts = (c.to_pylist() for c in batch.columns)
        for key, out, found in zip(k, h, predict(texts, *shared.value), strict=True):
            yield key, out, *found

    k = docs[key].cast("long")
    return docs.select(k.alias("doc_id"), F.coalesce(held_out(k), F.lit(False)).alias("held_out"), docs[text].cast("string").alias("text")).mapInArrow(common.by_rows(SCHEMA, each), "doc_id long, held_out boolean, lang_pred string, score double")
