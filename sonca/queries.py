"""The registered queries: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import session
from .functions import hashes, ids
from .operators import cdx, filters, index, lines, ngrams, rdr, syllables, tokens, typed, vocab, words
from .plans import jobs
from .schemas import CATEGORY_CODE, FENCE_NAMES

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.small_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, where the input has fewer splits than there are cores; else as they are, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if rows.rdd.getNumPartitions() <= cores else rows


def on_documents(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(documents(spark, sf_dir))


def on_tokens(f: Callable[[DataFrame], DataFrame]) -> Query:
    return on_documents(lambda d: f(tokens.tokenize(d)))


def on_types(f: Callable[[DataFrame], DataFrame]) -> Query:
    return on_documents(lambda d: f(vocab.types_of(d)))


def on_words(f: Callable[[DataFrame], DataFrame]) -> Query:
    return on_types(lambda t: f(t.where("category <> 'nonalpha'")))


def on_symbols(f: Callable[[DataFrame], DataFrame]) -> Query:
    return on_documents(lambda d: f(ngrams.symbols(d)))


def on_space(*columns: str) -> Query:
    return lambda spark, _: ids.syllable_dim(spark).select("syllable_id", *columns)


def _escaped(d: DataFrame) -> DataFrame:
    """The texts with escapes put in."""
    t = F.replace(F.replace("text", F.lit(". "), F.lit(".\\n ")), F.lit(" the "), F.lit("\\tthe\\r "))
    return d.withColumn("text", t)


def _fencing(t: DataFrame) -> DataFrame:
    return t.groupBy(F.get(F.array(*map(F.lit, FENCE_NAMES)), F.col("fenced")).alias("fence")).agg(F.count(F.lit(1)).alias("n"))


def _attribute_bytes(t: DataFrame) -> DataFrame:
    code = reduce(lambda out, x: F.when(F.col("category") == x[0], x[1]).otherwise(out), CATEGORY_CODE.items(), F.lit(None))
    return t.groupBy("category", "fenced").agg(F.count(F.lit(1)).alias("n")).select("category", "fenced", tokens.attrs_byte(code, F.col("fenced")).alias("attrs_byte"), "n")


def _case_flags(t: DataFrame) -> DataFrame:
    return tokens.case_flags(t)


def _semi(s: DataFrame) -> DataFrame:
    """Trigrams whose first two words are a frequent pair."""
    pairs = ngrams.grams(s, 2).where("n_count >= 5").select(F.col("gram").alias("h"))
    return filters.semi(ngrams.grams(s, 3).withColumn("h", F.substring_index("gram", " ", 2)), pairs, "h").select("gram", "n_count")


def _turned(g: DataFrame) -> DataFrame:
    return g.select(F.array_join(F.reverse(F.split("gram", " ")), " ").alias("gram"))


def _bucket_score(s: DataFrame) -> DataFrame:
    """Scores of pairs, turned round so that some are unseen."""
    pairs = ngrams.grams(s, 2)
    return ngrams.bucket_scores(_turned(pairs).distinct(), pairs)


def _backoff(s: DataFrame) -> DataFrame:
    """Scores of the trigrams and of what they are when turned round."""
    uni, bi, tri = (ngrams.grams(s, n) for n in (1, 2, 3))
    asked = tri.select("gram", F.col("n_count").alias("c3")).unionByName(_turned(tri).withColumn("c3", F.lit(None).cast("long")))
    return ngrams.scored_by_backoff(asked, uni, bi)


def _buckets(s: DataFrame) -> DataFrame:
    return ngrams.bucket_sizes_of(ngrams.without_singles(ngrams.counts_of(s, (2, 3, 4), blank_aware=True)), "n")


def _summaries(s: DataFrame) -> DataFrame:
    """Of each length, zeros where no gram stands."""
    found = ngrams.summary_of(ngrams.counts_of(s, range(1, 6)), "n")
    lengths = s.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("n"))
    return lengths.join(found, "n", "left").select("n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_distinct", "n_total")])


def _collapse(s: DataFrame) -> DataFrame:
    c = s.select("doc_id", ngrams.collapsed(F.col("s")).alias("c"))
    return c.select("doc_id", F.size("c").alias("n_symbols"), F.size(F.array_remove("c", "#")).alias("n_words"))


def _routes(d: DataFrame) -> DataFrame:
    return lines.route(lines.stats(d)).groupBy("route").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("line_bytes").alias("n_bytes"))


def _route_check(d: DataFrame) -> DataFrame:
    """Routes are a partition of the lines."""
    r = lines.route(lines.stats(d)).groupBy("doc_id", "line_no").agg(F.count("route").alias("k"))
    return r.agg(F.count(F.lit(1)).alias("n_lines"), F.sum("k").alias("n_routed"), F.sum((F.col("k") > 1).cast("long")).alias("n_twice"))


def _index(d: DataFrame) -> DataFrame:
    """Figures of each posting list, which lies in parts by document."""
    p = index.gathered(index.document_postings(d), spread=8)
    first, last = F.element_at("docs", 1)["doc_id"], F.element_at("docs", -1)["doc_id"]
    total = F.aggregate("docs", F.lit(0).cast("long"), lambda a, x: a + F.aggregate(x["at"], F.lit(0).cast("long"), lambda b, y: b + y))
    return p.groupBy("token").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min(first).alias("first_doc"), F.max(last).alias("last_doc"), F.sum(total).alias("pos_sum"))


def _fnv(t: DataFrame) -> DataFrame:
    return t.select("token", "n", hashes.fnv1a32_column(F.col("token")).alias("hash"))


def _base64(spark: SparkSession, _: str) -> DataFrame:
    return ids.syllable_dim(spark).select("syllable_id", ids.to_base64(F.col("syllable_id")).alias("code")).withColumn("again", ids.from_base64(F.col("code")).cast("int"))


def _encode(spark: SparkSession, _: str) -> DataFrame:
    return ids.syllable_dim(spark).where("is_valid").select("syllable_id", ids.encode(*map(F.col, ("dau", "giua", "cuoi", "tone"))).cast("int").alias("encoded"))


def _parsed_types(t: DataFrame) -> DataFrame:
    return syllables.with_syllables(t)


def _syllable_types(t: DataFrame) -> DataFrame:
    return syllables.syllable_types(t)


def _ids_by_document(d: DataFrame) -> DataFrame:
    """Sums that tell whether each id stands in its place."""
    i = syllables.document_ids(d)
    added = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    placed = F.transform("ids", lambda v, at: F.when(v == 32767, 0).otherwise(v * (at % 1000 + 1)).cast("long"))
    syllable = F.filter("ids", lambda v: v != 32767)
    return i.select("doc_id", F.size("ids").alias("n_tokens"), F.size(syllable).alias("n_syllables"), added(syllable).alias("id_sum"), added(placed).alias("placed_sum"))


def _round_trip(d: DataFrame) -> DataFrame:
    """Ids of each line after writing and reading the compact encoding."""
    return cdx.read(cdx.encoded_lines(d)).select("doc_id", "line_no", F.size("ids").alias("n_symbols"), F.size(F.filter("ids", lambda x: x != 32767)).alias("n_syllables"))


def _oov(t: DataFrame) -> DataFrame:
    return _parsed_types(t).where("syllable_id is null").select("token", "category", "n")


def _sentences(d: DataFrame) -> DataFrame:
    """sent_id, syllables: the words of each line that has some."""
    rows = tokens.line_words(d).select(F.concat_ws(":", "doc_id", "line_no").alias("sent_id"), F.col("words").alias("syllables"))
    return rows.where(F.size("syllables") > 0)


def _dictionary(d: DataFrame) -> DataFrame:
    """word, n: the pairs and triples of words that are frequent."""
    s = _sentences(d).select(F.col("syllables").alias("s"))
    return ngrams.grams_of(s, (2, 3)).where("n_count >= 5").select(F.col("gram").alias("word"), F.col("n_count").alias("n"))


def _segmented(d: DataFrame) -> DataFrame:
    return words.segmented(_sentences(d), _dictionary(d)).select("sent_id", F.array_join("tags", "").alias("tags"))


def _greedy(d: DataFrame) -> DataFrame:
    return words.greedy(_sentences(d), _dictionary(d)).select("sent_id", F.array_join("tags", "").alias("tags"))


def _flags(d: DataFrame) -> DataFrame:
    return words.flagged(_sentences(d), _dictionary(d))


def _restored(d: DataFrame) -> DataFrame:
    """Words without their accents, and the likeliest accents."""
    bare = lambda x: F.translate(x, "àáâäéèêëíìîïóòôöúùûüñç", "aaaaeeeeiiiioooouuuunc")
    said = _sentences(d)
    types = said.select(F.explode("syllables").alias("vocab")).groupBy("vocab").agg(F.count(F.lit(1)).alias("n"))
    options = types.groupBy(bare(F.col("vocab")).alias("bare")).agg(F.sort_array(F.collect_list(F.struct("n", "vocab")), asc=False).alias("variants"))
    pairs = ngrams.grams(said.select(F.col("syllables").alias("s")), 2)
    out = words.restored(said.withColumn("syllables", F.transform("syllables", bare)), options, pairs)
    return out.select("sent_id", F.array_join("restored", " ").alias("restored"))


#: Rules in the public text form, made up for words of the test tables.
RULES = """
True : object.conclusion = ""
	object.tag == "B" : object.conclusion = "B"
		object.prevWord1 == "of" and object.word == "the" : object.conclusion = "I"
			object.nextTag1 == "I" : object.conclusion = "B"
			object.prevWord2 == "and" : object.conclusion = "B"
		object.word == "de" and object.prevTag1 == "I" : object.conclusion = "I"
	object.tag == "I" : object.conclusion = "I"
		object.word == "and" : object.conclusion = "B"
			object.prevTag2 == "B" and object.nextWord1 == "the" : object.conclusion = "I"
"""


def _retagged(d: DataFrame) -> DataFrame:
    """Tags of a segmentation by longest words, corrected by rules."""
    (top,) = rdr.load(RULES)
    tagged = rdr.retag(words.greedy(_sentences(d), _dictionary(d)), top.exceptions)
    return tagged.select("sent_id", F.array_join("tags", "").alias("tags"), F.array_join("new_tags", "").alias("new_tags"))


def _hash_counts(d: DataFrame) -> DataFrame:
    return filters.hash_counts(syllables.document_ids(d).select(F.explode(F.filter("ids", lambda x: x != 32767)).alias("i")).select(F.array("i").alias("ids")))


def _fuse(s: DataFrame) -> DataFrame:
    """Trigrams whose first two words are in a filter of frequent pairs: how many are, are missed, and whether few others are.

    Both answers hang on the pair alone, so trigrams are counted by pair first, and each pair is asked about once.
    """
    key = lambda c: F.xxhash64(c).alias("key")
    pairs = ngrams.grams(s, 2).where("n_count >= 5").select(key(F.col("gram"))).distinct()
    heads = ngrams.grams(s, 3).groupBy(key(F.substring_index("gram", " ", 2))).agg(F.count(F.lit(1)).alias("n"))
    found = filters.marked(heads, pairs, "near", shard_keys=1 << 10).join(pairs.withColumn("exact", F.lit(True)), "key", "left")
    exact, near = F.coalesce("exact", F.lit(False)), F.col("near")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return found.agg(count(exact).alias("n_exact"), count(exact & ~near).alias("n_missed"), (count(~exact & near) <= 5 + 0.001 * count(F.lit(True))).alias("few_more"))


def _fuse_sizes(s: DataFrame) -> DataFrame:
    text = F.md5(F.encode("gram", "UTF-8"))
    pairs = ngrams.grams(s, 2).select(F.conv(F.substring(text, 1, 15), 16, 10).cast("long").alias("key"))
    built, _ = filters.build(pairs, shard_keys=1 << 14)
    return built.select("shard", "n_keys", F.octet_length("prints").cast("long").alias("n_bytes"))


def _hashes(t: DataFrame) -> DataFrame:
    return t.select("token", hashes.of_text("xxh32")(F.col("token")).alias("xxh32"), hashes.of_text("city32")(F.col("token")).alias("city32"))


def _discounted(s: DataFrame) -> DataFrame:
    """Scores of the pairs and of what they are when turned round."""
    both = ngrams.grams_of(s, (1, 2))
    uni, bi = (both.where(F.col("n") == n).select("gram", "n_count") for n in (1, 2))
    return ngrams.absolute_discount(bi.select("gram").union(_turned(bi)).distinct(), uni, bi)


def _attributes(t: DataFrame) -> DataFrame:
    """The bytes of all tokens' attributes, and what is read from them."""
    a = cdx.attribute(F.col("attrs_byte"))
    return _attribute_bytes(t).select("attrs_byte", "n").select("attrs_byte", a["category"].alias("category"), a["fenced"].alias("fenced"), "n")


def _features(spark: SparkSession, _: str) -> DataFrame:
    rows = ids.syllable_dim(spark).withColumn("s", F.struct("dau", "giua", "cuoi", "tone"))
    return rows.select("syllable_id", *[c.alias(k) for k, c in ids.features(F.col("s")).items()])


def _from_dense(spark: SparkSession, _: str) -> DataFrame:
    """Each rendering of the space, read again."""
    return ids.from_dense(ids.syllable_dim(spark).select("dense").distinct()).select("dense", "syllable_id")


def vietnamese(spark: SparkSession, _: str) -> DataFrame:
    """doc_id, text: made-up documents of all renderings of the id space, in lower, capital and upper case."""
    dim = ids.syllable_dim(spark).where(~F.col("giua").isin("ah", "oah")).select("syllable_id", "utf8")
    case = F.col("syllable_id") % 3
    word = F.when(case == 1, F.initcap("utf8")).when(case == 2, F.upper("utf8")).otherwise(F.col("utf8"))
    stop = F.when(F.col("syllable_id") % 11 == 0, ".\n").when(F.col("syllable_id") % 5 == 0, ", ").otherwise(" ")
    rows = dim.select((F.col("syllable_id") % 100).cast("long").alias("doc_id"), F.struct("syllable_id", F.concat(word, stop).alias("w")).alias("x"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["w"]), "").alias("text"))


def on_vietnamese(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(vietnamese(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "tokenize": on_tokens(lambda t: t),
    "tokenize_escapes": on_documents(lambda d: tokens.tokenize(_escaped(d))),
    "token_category_counts": on_tokens(lambda t: t.groupBy("category").agg(F.count(F.lit(1)).alias("n"))),
    "token_fencing": on_tokens(_fencing),
    "limit_lines": on_documents(lambda d: tokens.line_tokens(d, max_lines=2)),
    "line_numbers": on_documents(lambda d: tokens.line_tokens(d).groupBy("doc_id", "line_no").agg(F.count(F.lit(1)).alias("n_tokens"))),
    "token_at": on_documents(lambda d: tokens.token_at(d, 3)),
    "case_flags": on_types(_case_flags),
    "attribute_bytes": on_tokens(_attribute_bytes),
    "attribute_decode": on_tokens(_attributes),
    "vocab_alphabet": on_words(lambda t: t),
    "vocab_nonalpha": on_types(lambda t: t.where("category = 'nonalpha'")),
    "token_totals": on_tokens(vocab.totals),
    "top_types": on_words(lambda t: vocab.by_count(t, 100)),
    "longest_types": on_words(lambda t: vocab.by_length(t, 100)),
    "token_type_join": on_documents(typed.with_counts),
    "type_listing": on_words(vocab.wrapped),
    "unigrams": on_symbols(lambda s: ngrams.grams(s, 1)),
    "bigrams": on_symbols(lambda s: ngrams.grams(s, 2)),
    "trigrams": on_symbols(lambda s: ngrams.grams(s, 3)),
    "fourgrams": on_symbols(lambda s: ngrams.grams(s, 4)),
    "fivegrams": on_symbols(lambda s: ngrams.grams(s, 5)),
    "ngrams_6_8": on_symbols(lambda s: ngrams.grams_of(s, range(6, 9))),
    "ngrams_blank_aware": on_symbols(lambda s: ngrams.blank_aware_of(s, range(1, 5), padded=True)),
    "blank_collapse": on_symbols(_collapse),
    "ngram_summary": on_symbols(_summaries),
    "ngram_min_count": on_symbols(lambda s: ngrams.pruned(ngrams.grams(s, 2), distinct=1000)),
    "count_buckets": on_symbols(_buckets),
    "ngram_semi": on_symbols(_semi),
    "lm_bucket_score": on_symbols(_bucket_score),
    "stupid_backoff": on_symbols(_backoff),
    "absolute_discount": on_symbols(_discounted),
    "ngram_pruned": on_symbols(lambda s: ngrams.pruned(ngrams.grams(s, 2))),
    "line_stats": on_documents(lines.stats),
    "line_route": on_documents(_routes),
    "route_union_check": on_documents(_route_check),
    "rebuilt_lines": on_documents(lines.rebuilt),
    "syllable_id_decode": on_space("dau", "giua", "cuoi", "tone"),
    "valid_syllable_dim": lambda spark, _: ids.syllable_dim(spark).where("is_valid").select("syllable_id", "dau", "giua", "cuoi", "tone"),
    "syllable_id_encode": _encode,
    "render_dense": on_space("dense"),
    "render_spare": on_space("spare"),
    "render_parts": on_space("parts"),
    "render_utf8": lambda spark, _: ids.syllable_dim(spark).where(~F.col("giua").isin("ah", "oah")).select("syllable_id", "utf8"),
    "id_base64": _base64,
    "strip_tone_mark": lambda spark, _: ids.syllable_dim(spark).select("syllable_id", ids.without_tone_and_mark(F.col("dense")).alias("bare")),
    "dedup_lines": on_documents(index.first_lines),
    "inverted_index": on_documents(_index),
    "phrase_search": on_tokens(lambda t: index.phrase(t, ["of", "the"])),
    "fnv1a32": on_words(_fnv),
    "hashes": on_words(_hashes),
    "syllable_parse": on_words(_parsed_types),
    "can_be_vietnamese": on_words(syllables.vietnamese),
    "tokens_with_ids": on_documents(_ids_by_document),
    "vocab_syllable": on_words(_syllable_types),
    "vocab_syllower": on_words(lambda t: syllables.lower_types(_syllable_types(t))),
    "vocab_syllow00": on_words(lambda t: syllables.bare_types(_syllable_types(t))),
    "vocab_syllovan": on_words(lambda t: syllables.rime_types(_syllable_types(t))),
    "oov_types": on_words(_oov),
    "syllable_ngrams": on_documents(lambda d: ngrams.shown(ngrams.grams_of(ngrams.syllable_symbols(d), range(1, 4)))),
    "rendered_lines": on_documents(lambda d: lines.route(syllables.rendered_lines(d))),
    "cdx_roundtrip": on_documents(_round_trip),
    "rarely_used_ids": on_words(jobs.rarely_used),
    "rarely_used_of_tone": on_words(lambda t: jobs.rarely_used(t, "s")),
    "syllable_features": _features,
    "dense_to_id": _from_dense,
    "vietnamese_parse": on_vietnamese(lambda d: _parsed_types(vocab.types_of(d).where("category <> 'nonalpha'"))),
    "vietnamese_lines": on_vietnamese(lambda d: lines.route(syllables.rendered_lines(d))),
    "vietnamese_ngrams": on_vietnamese(lambda d: ngrams.shown(ngrams.grams_of(ngrams.syllable_symbols(d), (1, 2)))),
    "invalid_ids": lambda spark, _: jobs.unreadable(spark),
    "hash_count": on_documents(_hash_counts),
    "fuse_membership": on_symbols(_fuse),
    "fuse_sizes": on_symbols(_fuse_sizes),
    "word_lattice_flags": on_documents(_flags),
    "word_segmentation": on_documents(_segmented),
    "word_greedy": on_documents(_greedy),
    "rdr_retag": on_documents(_retagged),
    "tones_restored": on_documents(_restored),
}
