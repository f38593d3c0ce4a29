"""Whole jobs: vocabulary and re-rendered text of a corpus, n-gram tables of encoded text, statistics of the id space."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import lines, ngrams, syllables, tokens, vocab
from ..sources import text as io

#: Folders of what `telexify` writes.
LAYOUT = {
    "alphabet": "01-alphabet_freqs", "marked": "02-alphabet_by_mark", "oov": "03-oov_by_mark", "nonalpha": "04-nonalpha_freqs", "nonalpha_listing": "05-nonalpha_listing",
    "syllables": "11-syllable_freqs", "syllower": "12-syllower_freqs", "syllow00": "13-syllow00_freqs", "listing": "14-syllable_listing", "text": "out", "grams": "21-{n}_grams",
}


def telexify(docs: DataFrame, out: str, mode: str = "dense", grams: bool = False, routed: bool = True, keep_origin: bool = True) -> dict[str, int]:
    """Writes vocabularies, routed text and, if asked, n-gram counts of 1 to 8 syllables; returns totals by category.

    The types are counted once and kept on disk, as all vocabularies come from them.
    """
    found = tokens.tokenize(docs)
    types = vocab.types(found).persist(StorageLevel.DISK_ONLY)
    at = lambda name, **k: f"{out}/{LAYOUT[name].format(**k)}"
    alphabet, other = types.where("category <> 'nonalpha'"), types.where("category = 'nonalpha'")
    io.write_frequencies(alphabet, at("alphabet"))
    known = syllables.with_syllables(alphabet)
    io.write_with_marks(known, at("marked"))
    io.write_with_marks(known, at("oov"), skip_syllables=True)
    io.write_frequencies(other, at("nonalpha"))
    io.write_listing(other, at("nonalpha_listing"))
    syll = syllables.syllable_types(alphabet, mode)
    io.write_frequencies(syll, at("syllables"), "vocab")
    io.write_frequencies(syllables.lower_types(syll), at("syllower"), "vocab")
    io.write_frequencies(syllables.bare_types(syll), at("syllow00"), "vocab")
    io.write_listing(syll.withColumnRenamed("vocab", "token"), at("listing"))
    shown = syllables.rendered_lines(docs, mode, keep_origin=keep_origin)
    io.write_routed(lines.route(shown) if routed else shown.withColumn("route", F.lit("main")), at("text"))
    if grams:
        s = ngrams.syllable_symbols(docs)
        counts = ngrams.grams_of(s, range(1, 9)).persist(StorageLevel.DISK_ONLY)
        for n in range(1, 9):
            own = counts.where(F.col("n") == n).select("gram", "n_count")
            io.write_grams(ngrams.shown(ngrams.pruned(own)).select("n_count", F.col("shown").alias("gram")), at("grams", n=n))
        counts.unpersist()
    totals = {r["category"]: r["n"] for r in types.groupBy("category").agg(F.sum("n").alias("n")).collect()}  # three rows at most
    types.unpersist()
    return totals


def telegram(spark: SparkSession, path: str, out: str) -> dict[int, int]:
    """Writes the blank-aware 1- to 4-grams of encoded text by bucket; returns how many distinct ones there are."""
    held = io.encoded(spark, path).select(F.transform("ids", lambda i: F.when(i == 32767, "#").otherwise(i.cast("string"))).alias("s"))
    counts = ngrams.without_singles(ngrams.blank_aware_of(held, range(1, 5), padded=True))
    io.write_buckets(counts, out)
    sizes = {r["n"]: r["count"] for r in spark.read.parquet(out).groupBy("n").count().collect()}
    return {n: sizes.get(n, 0) for n in range(1, 5)}


def stats(spark: SparkSession, frequencies: DataFrame | None = None) -> dict[str, int]:
    """Sizes of the id space, and how many valid ids a frequency list (token, n) of syllables never has."""
    dim = ids.syllable_dim(spark)
    out = {"valid": dim.where("is_valid").count(), "invalid": dim.where("not is_valid").count()}
    if frequencies is not None:
        out["rare"] = rarely_used(frequencies).count()
    return out


def rarely_used(frequencies: DataFrame, tone: str | None = None) -> DataFrame:
    """syllable_id, utf8, tone of the valid ids that no listed token (token, category) has; with one tone, if it is given."""
    seen = syllables.with_syllables(frequencies).where("syllable_id is not null").select("syllable_id").distinct()
    dim = ids.syllable_dim(frequencies.sparkSession).where("is_valid")
    dim = dim if tone is None else dim.where(F.col("tone") == tone)
    return dim.join(seen, "syllable_id", "left_anti").select("syllable_id", "utf8", "tone")


def unreadable(spark: SparkSession) -> DataFrame:
    """syllable_id, utf8 of the ids whose rendering the parser does not take."""
    return syllables.vietnamese(ids.syllable_dim(spark).select("syllable_id", "utf8"), "utf8").where("not can_be_vietnamese").select("syllable_id", "utf8")
