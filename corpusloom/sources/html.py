"""Passages and links of HTML pages, from one pass over the markup.

Text in an open h1 or h2 is a header passage, other text a body passage. Nothing is taken from script, style, iframe, aside, nav and footer, nor
from a div whose class or id has ad, banner or promo in it; such a region ends at the first end tag of its own name. Self-closing tags
and comments do nothing.
"""

from __future__ import annotations

import html
import re
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import absolute_url, host, normalized_url, same_origin
from ..runtime import ship
from .robots import allowed

DROPPED = frozenset("script style iframe aside nav footer".split())
RAW = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())
_MARK = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!--?>|<[!?][^>]*>|</([A-Za-z][^\s/>]*)[^>]*>|</[^A-Za-z>][^>]*>|</>|<([A-Za-z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>", re.S
)
_ENTITY = re.compile(r"&(?:#(?:\d+|[xX][\da-fA-F]+)|[A-Za-z][A-Za-z\d]*);")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)


def _attributes(text: str) -> list[tuple[str, str]]:
    return [(k.lower(), html.unescape(a or b or c or "")) for k, a, b, c in _ATTRIBUTE.findall(text)]


def _closed(entity: re.Match) -> str:
    return html.unescape(entity[0]) if entity[0][1] == "#" or entity[0][1:] in html5 else entity[0]


def parse(page: str, links_in_garbage: bool = False, open_entities: bool = True) -> tuple[list[tuple[str, str]], list[str]]:
    """((type, text) of the passages, raw href of the links), in their order.

    open_entities: as browsers do, those of a text that lack their semicolon (&amp at a cut) are decoded too, where HTML has a name for that; else they are text.
    """
    decoded = html.unescape if open_entities else lambda text: _ENTITY.sub(_closed, text)
    passages: list[tuple[str, str]] = []
    links: list[str] = []
    headers: list[str] = []
    garbage: list[str] = []

    def emit(text: str, raw: bool = False) -> None:
        if not garbage:
            text = (text if raw else decoded(text)).strip()
            if text:
                passages.append(("h" if headers else "b", text))

    at = 0
    while m := _MARK.search(page, at):
        emit(page[at : m.start()])
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name[0] == "h" and len(name) > 1 and headers and headers[-1] == name[1]:
                headers.pop()
            if garbage and garbage[-1] == name:
                garbage.pop()
        elif m[2]:
            name, rest = m[2].lower(), m[3]
            if not rest.endswith("/"):
                if not garbage or links_in_garbage:
                    if name == "a" and (href := next((v for k, v in _attributes(rest) if k == "href"), None)) is not None:
                        links.append(href)
                if not garbage:
                    if name in ("h1", "h2"):
                        headers.append(name[1])
                    elif name == "div":
                        values = [v.lower() for k, v in _attributes(rest) if k in ("class", "id")]
                        if any(word in v for v in values for word in ("ad", "banner", "promo")):
                            garbage.append(name)
                    elif name in DROPPED:
                        garbage.append(name)
            if name in RAW:
                # its text has no tags in it
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                stop = end.start() if end and name != "plaintext" else len(page)
                emit(page[at:stop], raw=name not in ("title", "textarea"))
                at = stop
    emit(page[at:])
    return passages, links


PAGES = 128  # pages whose passages and links are Python's objects at once


def _told(pages: pa.Array, links_in_garbage: bool, open_entities: bool, texts: bool, hrefs: bool) -> pa.Array:
    """passages and hrefs of the pages of a batch, of which there may be many: only some at once are more than arrays."""
    text, done = pa.struct([("type", pa.string()), ("text", pa.string())]), []
    for at in range(0, len(pages), PAGES):
        kinds, bodies, links, ends, stops = [], [], [], [0], [0]
        for page in pages.slice(at, PAGES).to_pylist():
            p, a = parse(page, links_in_garbage, open_entities) if page else ((), ())
            if texts:
                kinds += [k for k, _ in p]
                bodies += [x for _, x in p]
            if hrefs:
                links += a
            ends.append(len(kinds))
            stops.append(len(links))
        both = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(bodies, pa.string())], fields=list(text))
        done.append(pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both), pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(links, pa.string()))], ["passages", "hrefs"]))
    return pa.concat_arrays(done) if done else pa.array([], pa.struct([("passages", pa.list_(text)), ("hrefs", pa.list_(pa.string()))]))


def parsed(pages: DataFrame, links_in_garbage: bool = False, key: str = "page_id", open_entities: bool = True, texts: bool = True, hrefs: bool = True) -> DataFrame:
    """key, url, passages (array of type and text) and hrefs of every page with HTML; without texts or hrefs those are empty."""
    ship(pages.sparkSession)

    def run(text: pa.Array) -> pa.Array:
        return _told(text, links_in_garbage, open_entities, texts, hrefs)

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    p = pages.where("length(html) > 0").select(key, "url", F.arrow_udf(run, "struct<passages:array<struct<type:string,text:string>>,hrefs:array<string>>")(F.col("html")).alias("p"))
    return p.select(key, "url", "p.passages", "p.hrefs")


def passages(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """doc_id, ord, type, text."""
    return parsed.select(F.col(key).alias("doc_id"), F.posexplode("passages").alias("ord", "p")).select("doc_id", "ord", "p.type", "p.text")


def links(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """src_id, base, ord, href, link (absolute; unusable ones are left out) and same_domain."""
    raw = parsed.select(F.col(key).alias("src_id"), F.col("url").alias("base"), F.posexplode("hrefs").alias("ord", "href"))
    found = raw.withColumn("link", absolute_url(F.col("href"), F.col("base"))).where("link is not null")
    return found.withColumn("same_domain", same_origin(F.col("link"), F.col("base")))


def followed(links: DataFrame, depth: int, rules: DataFrame | None = None, agent: str = "*", visited: DataFrame | None = None) -> DataFrame:
    """The links of pages at a depth that a crawler follows, numbered anew by ord in each page.

    Links that the rules of their host (robots.rules) bar go. visited (url as urls.normalized gives it, depth): a link that was met at this depth or nearer
    goes too; one met farther off stays, after the new ones.
    """
    out = links
    if rules is not None:
        at = out.withColumn("host", host(F.col("link"))).withColumn("path", F.regexp_extract("link", r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1))
        out = allowed(at, rules, agent).where("allowed").drop("host", "path", "allowed", "delay")
    if visited is None:
        return out
    known = visited.groupBy(F.col("url").alias("norm")).agg(F.min("depth").alias("met"))
    out = out.withColumn("norm", normalized_url(F.col("link"))).join(known, "norm", "left").where(F.col("met").isNull() | (F.col("met") > depth))
    n = F.row_number().over(Window.partitionBy("src_id").orderBy(F.col("met").isNotNull(), "ord")) - 1
    return out.withColumn("ord", n).drop("norm", "met")


def usable(fetched: DataFrame) -> DataFrame:
    """Of fetched pages with status and content_type those that are parsed: status 200 to 299, some text/html, in any case."""
    return fetched.where((F.col("status") >= 200) & (F.col("status") < 300) & F.contains(F.lower("content_type"), F.lit("text/html")))


def typed(kind: Column, text: Column) -> Column:
    """A passage as (type, text); any type but b, h and q (body, header, query) fails the query."""
    known = F.when(kind.isin("b", "h", "q"), kind).otherwise(F.raise_error(F.concat(F.lit("unknown type of passage: "), F.coalesce(kind, F.lit("null")))))
    return F.struct(known.cast("string").alias("type"), text.alias("text"))


def full_text(passages: DataFrame) -> DataFrame:
    """doc_id, text: the passages joined without a separator, for embedding."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return passages.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda p: p["text"]), "").alias("text"))


__all__ = ["parse", "parsed", "passages", "links", "followed", "usable", "typed", "full_text", "host"]
