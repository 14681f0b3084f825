"""URL allow and block lists.

A URL becomes a sequence of tokens: its host labels from the last to the first, a separator, its path segments. So does
each list entry; an entry holds for a URL if its tokens begin the URL's. A host entry thus covers subdomains and every
path, a path entry one host. Entries live in a trie that is broadcast, and the deepest one met on the walk decides, be
it of the allow or the block list; where both lists have the same entry, block wins. A list too large to broadcast is
joined on prefixes instead, with the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

TRIE_LIMIT = 8 << 20  # bytes of entries that are broadcast; as nested dicts they take several times that in each worker
SEPARATOR = "/"

_URL = re.compile(r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::[^/?#]*)?([^?#]*)", re.I)
_IP = re.compile(r"^(\d{1,3}(\.\d{1,3}){3}|\[.*\])$")


def tokens(url: str | None) -> list[str] | None:
    """None for a null and for a text without // and a host. Query, fragment, port, user and empty segments don't count."""
    m = _URL.match(url) if url else None
    host = m[1].lower().rstrip(".") if m else ""
    if not host:
        return None
    labels = [host] if _IP.match(host) else host.split(".")[::-1]
    return labels + [SEPARATOR] + [s for s in m[2].strip().split("/") if s]


def entry_tokens(entry: str) -> list[str] | None:
    """Of an entry such as example.com, example.com/path or a URL; without a path it ends before the separator."""
    t = tokens(entry if "//" in entry else "//" + entry)
    return t[:-1] if t and t[-1] == SEPARATOR else t


class Trie:
    """Nested dicts; the entry that ends at a node is under None."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for entry, action in sorted(rules):
            if (t := entry_tokens(entry)) is None:
                continue
            node = self.root
            for x in t:
                node = node.setdefault(x, {})
            if node.get(None, ("",))[0] != "block":
                node[None] = (action, SEPARATOR.join(t), len(t))

    def longest(self, t: list[str]) -> tuple[str, str, int] | None:
        node, best = self.root, self.root.get(None)
        for x in t:
            node = node.get(x)
            if node is None:
                break
            best = node.get(None, best)
        return best


RESULT = "struct<action:string,entry:string,depth:int>"
DEFAULT, INVALID = "default", "invalid"


def decisions(pages: DataFrame, rules: DataFrame, limit: int = TRIE_LIMIT) -> DataFrame:
    """page_id, url, action, entry (its tokens joined by /) and depth (their number) of every row.

    rules has the columns entry and action ("allow" or "block"); nulls, other actions and entries without a host are
    left out. A URL that no entry matches is "default" with a null entry and depth 0; one that is null, empty or without a host is "invalid".
    Repeated rows are decided alike and all stay; repeated rules count once; other columns are ignored; an empty table
    gives an empty result.
    """
    usable = rules.select("entry", "action").where("entry is not null and action in ('allow', 'block')")
    size = usable.agg(F.coalesce(F.sum(F.octet_length("entry") + 64), F.lit(0)).alias("n")).first()["n"]
    if size <= limit:
        return by_trie(pages, [(r["entry"], r["action"]) for r in usable.collect()])
    return by_join(pages, usable)


def by_trie(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    spark = pages.sparkSession
    ship(spark)
    trie = spark.sparkContext.broadcast(Trie(rules))

    def run(urls: pa.Array) -> pa.Array:
        t, out = trie.value, []
        for u in urls.to_pylist():
            x = tokens(u)
            best = None if x is None else t.longest(x)
            out.append((INVALID if x is None else DEFAULT, None, 0) if best is None else best)
        a, e, d = zip(*out) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(a, pa.string()), pa.array(e, pa.string()), pa.array(d, pa.int32())], ["action", "entry", "depth"])

    run.__annotations__ = {"urls": pa.Array, "return": pa.Array}
    f = F.arrow_udf(run, RESULT)
    return pages.select("page_id", "url", f(F.col("url")).alias("r")).select("page_id", "url", "r.action", "r.entry", "r.depth")


def _token_udf(f):
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v) for v in values.to_pylist()], pa.list_(pa.string()))

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>")


def by_join(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by an equi-join of URL prefixes with entries, for lists that grow with the data."""
    ship(pages.sparkSession)
    entries = rules.select(_token_udf(entry_tokens)(F.col("entry")).alias("t"), "action").where("t is not null")
    entries = entries.groupBy(F.array_join("t", SEPARATOR).alias("entry"), F.size("t").alias("depth")).agg(F.max("action").alias("action"))
    urls = pages.select("url").where("url is not null").distinct().withColumn("t", _token_udf(tokens)(F.col("url"))).where("t is not null")
    prefixes = urls.select("url", F.explode(F.transform(F.sequence(F.lit(1), F.size("t")), lambda i: F.array_join(F.slice("t", F.lit(1), i), SEPARATOR))).alias("entry"))
    best = prefixes.join(entries, "entry").groupBy("url").agg(F.max_by(F.struct("action", "entry", "depth"), "depth").alias("r"))
    best = urls.select("url").join(best, "url", "left")
    kind = F.when(F.col("known").isNull(), INVALID).otherwise(F.coalesce("r.action", F.lit(DEFAULT)))
    joined = pages.where("url is not null").select("page_id", "url").join(best.withColumn("known", F.lit(1)), "url", "left")
    out = joined.select("page_id", "url", kind.alias("action"), F.col("r.entry").alias("entry"), F.coalesce("r.depth", F.lit(0)).alias("depth"))
    # null URLs don't meet in one task of the join
    none = pages.where("url is null").select("page_id", "url", F.lit(INVALID).alias("action"), F.lit(None).cast("string").alias("entry"), F.lit(0).alias("depth"))
    return out.unionByName(none)
