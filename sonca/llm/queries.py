"""The registered queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, flac, html_extract, langid, minhash, packing, quality, substring_dedup, token_counts, warc
from .common import table

COUNTING, PACKING = "byte_bpe_50k.json", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample: a row for each document that is kept."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("kept").select("doc_id", "n_ngrams", "weight", "kept")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary(COUNTING))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(flac.media_columns(table(spark, sf_dir, "documents")))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(PACKING))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1,
    "op2_html_extraction": op2,
    "op3_quality_classifier": op3,
    "op4_token_counts": op4,
    "op5_media_columns": op5,
    "op6_language_id": op6,
    "op7_best_fit_packing": op7,
    "op8_warc": op8,
    "op9_substring_dedup": op9,
    "op10_minhash_near_dedup": op10,
}

ORACLE_SQL: dict[str, str] = {
    "op8_warc": """
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as hex, min(page_id) over (partition by html) as head from p),
g as (select *, list_transform(range(8), lambda i: ('0x' || substr(hex, (i * 5 + 1)::int, 5))::bigint) as parts from h)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((parts[(i // 4 + 1)::int] >> (15 - 5 * (i % 4))::int) & 31) + 1)::int, 1)), '') as payload_digest,
  case when head < page_id then 'revisit' else 'response' end as record_type,
  case when head < page_id then head end as refers_to
from g""",
    "op9_substring_dedup": r"""
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda v: v <> '') as w from documents),
s as (select doc_id, len(w) as n, unnest(range(1, len(w) - 18)) as i, w from d where len(w) >= 20),
k as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as x from s),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by x order by doc_id, i) as k from k) where k > 1),
c as (select distinct doc_id, i + j as at from r, (select unnest(range(20)) as j)),
w as (select doc_id, unnest(range(1, len(w) + 1)) as at, unnest(w) as word from d),
o as (select w.doc_id, count(c.at) as gone, coalesce(string_agg(case when c.at is null then word end, ' ' order by w.at), '') as kept from w left join c on w.doc_id = c.doc_id and w.at = c.at group by w.doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(gone, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join o using (doc_id)""",
    "op10_minhash_near_dedup": r"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda v: v <> '') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') as x from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
u as (select a, b from e union all select b, a from e),
c(doc_id, r) as (select doc_id, doc_id from d union select c.doc_id, u.b from c join u on c.r = u.a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(c.r) as component_id, min(c.r) = d.doc_id as kept from d left join n using (doc_id) join c using (doc_id) group by d.doc_id, n.n""",
}
