"""The queries of this subpackage for the driver, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table
from . import cover_join, decontam, langid, mixing, near_dup, ngram_lm, pii, templates, token_count, url_filter

URL_RULES = [
    ("spam-farm.example.org", "block"),
    ("spam-farm.example.com", "block"),
    ("adult-x.example.net", "block"),
    ("casino-win.example.com", "block"),
    ("free-bets.example.com", "block"),
    ("cheap-pills.example.com", "block"),
    ("ads-track.example.com", "block"),
    ("example.net/de", "block"),
    ("blog.tionsh.example.com", "block"),
    ("blog.tionsh.example.com/en", "allow"),
    ("blog.tionsh.example.net", "block"),
    ("blog.tionsh.example.net/en", "allow"),
    ("tionsh.example.net/de", "block"),
    ("tionsh.example.net", "allow"),
    ("tionble.example.org/fr", "block"),
    ("m.adult-x.example.net/en/196", "allow"),
]


def url_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(URL_RULES, "entry string, action string")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.decisions(table(spark, sf_dir, "pages"), url_rules(spark))


def op2_page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extracted(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymized(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.counted(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_join.linked(table(spark, sf_dir, "embeddings"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ngram_lm.scored(docs, ngram_lm.build(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_url_filter, op2_page_templates, op3_language_id, op4_mix_sources, op5_pii, op6_token_counts, op7_decontamination, op8_near_duplicates, op9_embedding_pairs, op10_lm_score)
    return {f.__name__: f for f in found}


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


URL_SQL = rf"""
with rules(entry, action) as (values {_values(URL_RULES)}),
parts as (
  select action, array_to_string(list_reverse(string_split(split_part(entry, '/', 1), '.')), '/')
    || case when contains(entry, '/') then '//' || substr(entry, instr(entry, '/')) else '' end as raw
  from rules),
entries as (select replace(raw, '///', '///') as raw, action from parts),
keyed as (
  select case when contains(raw, '//') then split_part(raw, '//', 1) || '///' || array_to_string(list_filter(string_split(substr(raw, instr(raw, '//') + 2), '/'), lambda x: x <> ''), '/') else raw end as entry, max(action) as action
  from entries group by 1),
urls as (
  select page_id, url,
    array_to_string(list_reverse(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '.')), '/')
      || '///' || array_to_string(list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''), '/') as t
  from pages),
hits as (
  select u.page_id, k.action, k.entry, len(list_filter(string_split(k.entry, '/'), lambda x: x <> '')) + (case when contains(k.entry, '///') then 1 else 0 end) as depth
  from urls u join keyed k on starts_with(u.t || '/', k.entry || '/')),
best as (select page_id, max_by(action, depth) as action, max_by(entry, depth) as entry, max(depth) as depth from hits group by page_id)
select u.page_id, u.url, coalesce(b.action, 'default') as action, b.entry, cast(coalesce(b.depth, 0) as integer) as depth
from urls u left join best b using (page_id)
"""


LINKS_SQL = f"""
with recursive e as (select row_number() over (order by vec_id, v) as n, * from (select distinct vec_id, cast(embedding as double[]) as v from embeddings where len(embedding) > 0)),
p as (select a.n as a, b.n as b from e a join e b on a.n <> b.n and list_cosine_similarity(a.v, b.v) >= {cover_join.THRESHOLD}),
r(n, least) as (select n, vec_id from e union select p.b, r.least from r join p on p.a = r.n)
select vec_id, (select min(least) from r where r.n = e.n) as class_id, (select count(*) from p where p.a = e.n) as n_links from e
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": URL_SQL, "op4_mix_sources": mixing.sql(), "op9_embedding_pairs": LINKS_SQL}
