"""n-gram counts with blanks, over arrays of a document's symbols: one shuffle, on the gram or on where it begins.

Symbols are token surfaces (or syllable ids as strings) with BLANK for what is no word. Windows never cross documents.
They are counted in Arrow batches (`windows`); long grams of several lengths travel together.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import decode, dense
from ..schemas import BLANK, NONE_ID
from . import scan, windows
from .syllables import document_ids

MIN_COUNT, MIN_DISTINCT = 10, 100_000
BUCKETS = (("a", 2), ("b", 5), ("c", 11), ("d", 25), ("e", 80))


def symbols(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, s: the symbols of each document in order, collapsed: no gram depends on how many blanks stand together."""
    return scan.symbols(docs, key, text)


def syllable_symbols(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, s: the syllable ids of each document in order, as strings; BLANK for all other tokens."""
    ids = document_ids(docs, key, text)
    return ids.select(F.col("doc_id").alias(key), F.transform("ids", lambda i: F.when(i == NONE_ID, BLANK).otherwise(i.cast("string"))).alias("s"))


def collapsed(s: Column) -> Column:
    """Symbols with runs of blanks made one, and a blank at either end. Symbols hold no spaces."""
    joined = F.concat(F.lit(f"{BLANK} "), F.array_join(s, " "), F.lit(f" {BLANK}"))
    return F.split(F.regexp_replace(joined, f"{BLANK}[ {BLANK}]*{BLANK}", BLANK), " ")


def grams_of(docs: DataFrame, lengths: Iterable[int]) -> DataFrame:
    """n, gram, n_count: up to three symbols without blanks; longer ones with blanks at one end at most."""
    padded = docs.select(F.concat(F.array(F.lit(BLANK)), F.col("s")).alias("s"))
    return windows.counted(padded, lengths, windows.plain)


def grams(docs: DataFrame, n: int) -> DataFrame:
    """gram, n_count of one length."""
    return grams_of(docs, [n]).drop("n")


def blank_aware_of(docs: DataFrame, lengths: Iterable[int], padded: bool = False) -> DataFrame:
    """n, gram, n_count for lengths of 1 to 4 over collapsed symbols.

    Padded symbols are collapsed already. After a blank all further symbols must be words; after a word the second may be blank in pairs, and the last in fours.
    """
    return windows.counted(docs.select((F.col("s") if padded else collapsed(F.col("s"))).alias("s")), lengths, windows.blanks)


def blank_aware(docs: DataFrame, n: int, padded: bool = False) -> DataFrame:
    """gram, n_count of one length."""
    return blank_aware_of(docs, [n], padded).drop("n")


def pruned(counts: DataFrame, least: int = MIN_COUNT, distinct: int = MIN_DISTINCT) -> DataFrame:
    """Grams of at least `least`, or all if there are fewer than `distinct`: a scalar subquery decides."""
    size = counts.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.where((F.col("n_count") >= least) | (size < distinct))


def without_singles(counts: DataFrame, n: int | None = None) -> DataFrame:
    """counts without the threes and fours that stand once; of one length n, or of the lengths in column n."""
    long = F.col("n").isin(3, 4) if n is None else F.lit(n in (3, 4))
    return counts.where((F.col("n_count") > 1) | ~long)


def bucket(n_count: Column) -> Column:
    out = None
    for name, most in BUCKETS:
        out = F.when(n_count <= most, name) if out is None else out.when(n_count <= most, name)
    return out.otherwise("f")


def counts_of(docs: DataFrame, lengths: Iterable[int], blank_aware: bool = False) -> DataFrame:
    """n, n_count, n_grams: how many grams have each count, in several rows; of plain grams, or blank-aware ones of padded symbols."""
    padded = docs if blank_aware else docs.select(F.concat(F.array(F.lit(BLANK)), F.col("s")).alias("s"))
    return windows.counted(padded, lengths, windows.blanks if blank_aware else windows.plain, sizes=True)


def bucket_sizes(counts: DataFrame, *by: str) -> DataFrame:
    return counts.groupBy(*by, bucket(F.col("n_count")).alias("bucket")).agg(F.count(F.lit(1)).alias("n_grams"), F.sum("n_count").alias("n_total"))


def bucket_sizes_of(sizes: DataFrame, *by: str) -> DataFrame:
    """`bucket_sizes` from how many grams have each count."""
    return sizes.groupBy(*by, bucket(F.col("n_count")).alias("bucket")).agg(F.sum("n_grams").alias("n_grams"), F.sum(F.col("n_count") * F.col("n_grams")).alias("n_total"))


def summary(counts: DataFrame, *by: str) -> DataFrame:
    return counts.groupBy(*by).agg(F.count(F.lit(1)).alias("n_distinct"), F.coalesce(F.sum("n_count"), F.lit(0)).alias("n_total"))


def summary_of(sizes: DataFrame, *by: str) -> DataFrame:
    """`summary` from how many grams have each count."""
    return sizes.groupBy(*by).agg(F.sum("n_grams").alias("n_distinct"), F.sum(F.col("n_count") * F.col("n_grams")).alias("n_total"))


def bucket_scores(queries: DataFrame, counts: DataFrame) -> DataFrame:
    """gram, score of given grams by the bucket of their count."""
    return queries.join(counts.select("gram", "n_count"), "gram", "left").select("gram", bucket_score(F.col("n_count")).cast("int").alias("score"))


def listing(counts: DataFrame) -> DataFrame:
    """value: `count gram`, the most frequent first; ties in order of the gram."""
    return counts.orderBy(F.desc("n_count"), "gram").select(F.concat_ws(" ", F.col("n_count").cast("string"), "gram").alias("value"))


def shown(counts: DataFrame) -> DataFrame:
    """counts of grams of syllable ids with `shown`, their dense renderings, by column functions."""
    one = lambda x: F.when(x == BLANK, x).otherwise(dense(decode(x.cast("int"))))
    return counts.withColumn("shown", F.array_join(F.transform(F.split("gram", " "), one), " "))


def bucket_score(count: Column) -> Column:
    """1 for unseen, 2 for up to 2, 4 for up to 5, else 8."""
    return F.when(count.isNull(), 1).when(count <= 2, 2).when(count <= 5, 4).otherwise(8)


def stupid_backoff(bi: DataFrame, tri: DataFrame) -> DataFrame:
    """gram, score of each trigram that was seen: its count over that of its first two words."""
    c2 = bi.select(F.col("gram").alias("h"), F.col("n_count").alias("c"))
    return tri.withColumn("h", F.substring_index("gram", " ", 2)).join(c2, "h", "left").select("gram", F.round(F.col("n_count") / F.col("c"), 9).alias("score"))


def backoff_score(queries: DataFrame, uni: DataFrame, bi: DataFrame, tri: DataFrame, alpha: float = 0.4) -> DataFrame:
    """gram, score of given trigrams: c3/c2, else alpha c2/c1, else alpha^2 c1/N; of any tables."""
    total = uni.agg(F.sum("n_count").cast("double").alias("total")).scalar()
    named = lambda t, key, out: t.select(F.col("gram").alias(key), F.col("n_count").alias(out))
    q = queries.withColumns({"h": F.substring_index("gram", " ", 2), "t": F.substring_index("gram", " ", -2), "m": F.element_at(F.split("gram", " "), 2), "w": F.substring_index("gram", " ", -1)})
    q = q.join(named(tri, "gram", "c3"), "gram", "left").join(named(bi, "h", "ch"), "h", "left").join(named(bi, "t", "ct"), "t", "left").join(named(uni, "m", "cm"), "m", "left").join(named(uni, "w", "cw"), "w", "left")
    score = F.coalesce(F.col("c3") / F.col("ch"), alpha * F.col("ct") / F.col("cm"), alpha * alpha * F.col("cw") / total, F.lit(0.0))
    return q.select("gram", F.round(score, 9).alias("score"))


def scored_by_backoff(asked: DataFrame, uni: DataFrame, bi: DataFrame, alpha: float = 0.4) -> DataFrame:
    """`backoff_score` of trigrams (gram, c3), whose count is null in rows that do not know it; each is scored once. The
    counts are all those of one text: a seen trigram's first pair is counted too, and a counted pair's first word.

    A row carries its gram and counts, and what is joined by is cut from the gram. A seen trigram needs its first pair
    and no more, another one its last pair, and then one word: so one join with the pairs and one with the words do. The
    rows that need no word go on under their whole gram, which is no word, and so lie spread.
    """
    total = uni.agg(F.sum("n_count").cast("double").alias("total")).scalar()
    c3, c2, c1 = map(F.col, ("c3", "c2", "c1"))
    q = asked.groupBy("gram").agg(F.max("c3").alias("c3"))
    pair = F.when(c3.isNotNull(), F.substring_index("gram", " ", 2)).otherwise(F.substring_index("gram", " ", -2))
    q = q.join(bi.select(F.col("gram").alias("pair"), F.col("n_count").alias("c2")), pair == F.col("pair"), "left").select("gram", "c3", "c2")
    word = F.when(c2.isNull(), F.substring_index("gram", " ", -1)).when(c3.isNull(), F.get(F.split("gram", " "), 1)).otherwise(F.col("gram"))
    q = q.join(uni.select(F.col("gram").alias("word"), F.col("n_count").alias("c1")), word == F.col("word"), "left")
    score = F.when(c2.isNull(), alpha * alpha * c1 / total).when(c3.isNull(), alpha * c2 / c1).otherwise(c3 / c2)
    return q.select("gram", F.round(F.coalesce(score, F.lit(0.0)), 9).alias("score"))


def discount(n_count: Column) -> Column:
    """What absolute discounting takes of a count: half of one that stands once, three quarters of a larger one."""
    return F.when(n_count == 1, 0.5).otherwise(0.75)


def absolute_discount(queries: DataFrame, uni: DataFrame, bi: DataFrame) -> DataFrame:
    """gram, score of given pairs: the discounted share of the pair after its first word, and what was taken there times
    the share of the second word among all; after an unseen word, that share alone."""
    total = uni.agg(F.sum("n_count").cast("double").alias("total")).scalar()
    after = bi.groupBy(F.substring_index("gram", " ", 1).alias("h")).agg(F.sum("n_count").alias("ch"), F.sum(discount(F.col("n_count"))).alias("taken"))
    q = queries.withColumns({"h": F.substring_index("gram", " ", 1), "w": F.substring_index("gram", " ", -1)})
    q = q.join(bi.select("gram", F.col("n_count").alias("c")), "gram", "left").join(after, "h", "left").join(uni.select(F.col("gram").alias("w"), F.col("n_count").alias("cw")), "w", "left")
    own = F.coalesce((F.col("c") - discount(F.col("c"))) / F.col("ch"), F.lit(0.0))
    rest = F.coalesce(F.col("taken") / F.col("ch"), F.lit(1.0)) * F.coalesce(F.col("cw"), F.lit(0)) / total
    return q.select("gram", F.round(own + rest, 9).alias("score"))
