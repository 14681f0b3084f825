"""Token streams of passages.

A passage is a row (doc_id, ord, type, text): type h for headers, b for bodies. A token is an address, or a lower-case run of letters and
digits. One regular expression finds them all; the run gives way where an address begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import STOP_WORDS, stem_sql, stemmed_column

_OCTET = r"(?:2[0-4]\d|25[0-5]|[01]?\d\d?)"
URL = r"https?://[-.A-Za-z\d]+(?:\.[A-Za-z]{2,})+/?\S*"
IPV4 = rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b"
EMAIL = r"^[-+%._A-Za-z\d]+@[-.A-Za-z\d]+\.[A-Za-z]{2,}$"
RUN = r"[\p{L}\p{Nd}]"
PATTERN = rf"{IPV4}|{RUN}++"
PATTERN_URL = rf"{URL}|{IPV4}|{RUN}+?(?={URL})|{RUN}++"  # for the texts that have a :// in them
LONGEST = 64  # bytes of an indexed token
INDEXED = ("WORD", "ALPHANUMERIC", "URL", "EMAIL")


def passages(documents: DataFrame) -> DataFrame:
    """Plain documents as one body passage each."""
    return documents.select("doc_id", F.lit(0).alias("ord"), F.lit("b").alias("type"), "text")


def _classed(raw: Column) -> Column:
    """token and class of a run or address. Only addresses have a full stop, only URLs a scheme."""
    kind = F.when(raw.contains("://"), "URL").when(raw.contains("."), "IPV4").when(~raw.rlike(r"\p{Nd}"), "WORD").when(~raw.rlike(r"\p{L}"), "NUMBER").otherwise("ALPHANUMERIC")
    return F.struct(F.when(raw.contains("://"), raw).otherwise(F.lower(raw)).alias("token"), kind.alias("class"))


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.when(text.contains("://"), PATTERN_URL).otherwise(PATTERN), F.lit(0))


def _mail(text: Column) -> Column:
    return text.contains("@") & text.rlike(EMAIL)


def runs(text: Column) -> Column:
    """The runs and addresses of a text as they are written. One with :// is a URL, else one with @ an e-mail address, else one with a full stop an IPv4 address."""
    return F.when(_mail(text), F.array(text)).otherwise(_runs(text))


def listed(text: Column) -> Column:
    """The tokens of a text, in their order, as an array of token and class. They are told once here; what comes later are plain columns."""
    return F.when(_mail(text), F.array(F.struct(text.alias("token"), F.lit("EMAIL").alias("class")))).otherwise(F.transform(_runs(text), _classed))


def _seen(token: Column, kind: Column) -> Column:
    """What queries see: no stop words, no IPv4 addresses."""
    return (kind != "IPV4") & ~((kind == "WORD") & token.isin(*STOP_WORDS))


def _stored(token: Column, kind: Column) -> Column:
    """What is indexed: no numbers, no term over 64 bytes. A stem is never longer than its word, so few words must be stemmed to tell."""
    short = (F.octet_length(token) <= LONGEST) | ((kind == "WORD") & (F.octet_length(stemmed_column(token)) <= LONGEST))
    return _seen(token, kind) & (kind != "NUMBER") & short


def tokens(passages: DataFrame) -> DataFrame:
    """doc_id, ord, type, tok (0-based in its passage), token, class of every token, stop words included."""
    t = passages.select("doc_id", "ord", "type", F.posexplode_outer(listed(F.col("text"))).alias("tok", "t"))
    return t.where("t is not null").select("doc_id", "ord", "type", "tok", "t.token", "t.class")


def kept(tokens: DataFrame) -> DataFrame:
    """Without stop words and IPv4 addresses: what queries see."""
    return tokens.where(_seen(F.col("token"), F.col("class")))


def with_term(tokens: DataFrame) -> DataFrame:
    """Adds the term: the stem of a word, any other token itself. Group equal tokens before, so that each is stemmed once."""
    return tokens.withColumn("term", F.when(F.col("class") == "WORD", stemmed_column(F.col("token"))).otherwise(F.col("token")))


def stemmed(tokens: DataFrame) -> DataFrame:
    """Kept tokens with their term."""
    return with_term(kept(tokens))


def indexed(passages: DataFrame) -> DataFrame:
    """doc_id, ord, type, token, class of the tokens that are indexed, not yet stemmed."""
    t = passages.select("doc_id", "ord", "type", F.explode_outer(_indexed(F.col("text"))).alias("t"))
    # a plain explode would have its array told twice, first to drop the empty ones
    return t.where("t is not null").select("doc_id", "ord", "type", "t.token", "t.class")


def _indexed(text: Column) -> Column:
    return F.filter(listed(text), lambda t: _stored(t["token"], t["class"]))


def term_counts(passages: DataFrame) -> DataFrame:
    """doc_id, term, tf."""
    from . import blocks

    return blocks.term_counts(passages)


def positioned(passages: DataFrame) -> DataFrame:
    """doc_id, type, term, pos: the indexed tokens with their running number in their document over all its passages."""
    from . import blocks

    return blocks.positioned(passages)


placed = positioned


# ---------------------------------------------------------------- the same in DuckDB's SQL, for tables without URLs
def sql_tokens(source: str = "documents", text: str = "text", key: str = "doc_id") -> str:
    """CTEs tok (all tokens), kept, stemmed, idx (index tokens) and pos."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
found as (select {key} as doc_id, regexp_extract_all({text}, '{IPV4}|{RUN}+') as ts from {source}),
flat as (select doc_id, unnest(ts) as raw, generate_subscripts(ts, 1) - 1 as tok from found),
tok as (
  select doc_id, tok, lower(raw) as token,
    case when regexp_full_match(raw, '\p{{L}}+') then 'WORD' when regexp_full_match(raw, '\p{{Nd}}+') then 'NUMBER'
      when contains(raw, '.') then 'IPV4' else 'ALPHANUMERIC' end as class
  from flat),
kept as (select * from tok where class <> 'IPV4' and not (class = 'WORD' and token in ({stops}))),
stems as ({stem_sql("kept", "token", "stem")}),
stemmed as (select doc_id, tok, token, class, case when class = 'WORD' then stem else token end as term from stems),
idx as (select * from stemmed where class <> 'NUMBER' and strlen(term) <= {LONGEST}),
pos as (select *, row_number() over (partition by doc_id order by tok) - 1 as pos from idx)"""
