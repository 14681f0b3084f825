"""URL functions. Resolving and percent-coding have no equal in Spark, so they are Arrow functions; the rest are columns."""

from __future__ import annotations

from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def absolute(raw: str | None, base: str | None) -> str | None:
    """The https URL that a link stands for on its page, without its fragment; None for other schemes, fragments and scripts."""
    link = (raw or "").strip()
    if not link or link.startswith("#") or link.startswith("javascript:"):
        return None
    try:
        out = urljoin(base or "", link).split("#")[0]
        parts = urlsplit(out)
    except ValueError:
        return None
    return out if parts.scheme == "https" else None


def normalized(url: str | None) -> str | None:
    """Host without www. and port, path, sorted query; no scheme, no fragment."""
    try:
        u = urlsplit((url or "").strip())
        host = (u.hostname or "").lower()
    except ValueError:
        return None
    if url is None:
        return None
    path = quote(u.path, safe="/%:@!$&'()*+,;=~-._")
    out = (host.removeprefix("www.") + path).replace("//", "/").removesuffix("/")
    query = sorted(parse_qsl(u.query, keep_blank_values=True), key=lambda kv: kv[0])
    return out + ("?" + urlencode(query) if query else "")


def _arrow(f, n: int) -> Column:
    if n == 1:

        def run(a: pa.Array) -> pa.Array:
            return pa.array([f(x) for x in a.to_pylist()], pa.string())

        run.__annotations__ = {"a": pa.Array, "return": pa.Array}
    else:

        def run(a: pa.Array, b: pa.Array) -> pa.Array:
            return pa.array([f(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.string())

        run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")


def absolute_url(raw: Column, base: Column) -> Column:
    return _arrow(absolute, 2)(raw, base)


def normalized_url(url: Column) -> Column:
    return _arrow(normalized, 1)(url)


def host(url: Column) -> Column:
    """Host and port as written, in lower case; empty without one."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def same_origin(link: Column, base: Column) -> Column:
    """Whether the base's host holds the link's host: a part of it will do, and an empty one."""
    return F.contains(host(base), host(link))


def document_id(url: Column) -> Column:
    """SHA-256 of the normalised URL."""
    return F.unhex(F.sha2(normalized_url(url), 256))
