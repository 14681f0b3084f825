"""Page templates of hosts by equivalence classes of tokens.

A page is a run of tags and words. A token's role is its name together with the path of elements it is in. Over the pages of a
host, roles with the same occurrence vector (so often on the first page, so often on the second, ...) form an equivalence class; classes of
frequent roles are the template, what lies between their tokens are its slots. It takes four passes over the pages, none
of which gathers a host in one place, so a host of any size is many tasks:
  1. roles hashed to buckets, and how many pages of the host have a role of each bucket. A frequent role is in a frequent bucket, wherever
     its pages lie, and few others are;
  2. the exact support of the roles in frequent buckets, and a fingerprint of their occurrence vector, the sum of hash(page, count) over the pages. Roles of a host
     with one fingerprint are a class;
  3. validity. On every page the k-th occurrences of a class's tags must keep one order and come before the (k + 1)-th ones; a word must
     keep its place between two of them; and a class must be nested, on every page, after the same token of one other
     class. What fails on a page goes: the token, or the whole class if it crosses others;
  4. extraction: the text between template tokens, by slot.
The template tables have a few hundred rows a host. They are broadcast if they are small, else joined by host.
"""

from __future__ import annotations

import html as entities
import os
import re
from collections import Counter
from functools import lru_cache
from math import ceil
from operator import mul

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import BROADCAST_LIMIT, ship, stored
from .common import packed, unpacked

MIN_PAGES = 3  # a template needs so many pages
SUPPORT = 0.6  # and its tokens so large a share of the host's pages

HOST = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
_PART = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?[A-Za-z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>|<[!?][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
DEEP = 200  # characters of a path
BUCKETS = 1 << 14  # of a host's roles
FLUSH = 1 << 20  # counts that a task holds before it passes them on
FAN = 1024  # counts of a host that one task adds up
WORDS = 32  # bits of the place of a word among those of its gap
BLOCK = 1 << 16  # characters of text whose words are hashed at once
GROUP = 64  # pages at most whose words are
LONG = 1024  # characters of a token that its bucket goes by
_SPACE = re.compile(r"\s")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = frozenset("html body table ul ol dl div article section nav main aside select header footer".split())


@lru_cache(1 << 16)
def _tag(name: str, rest: str) -> str:
    """A tag's name with its class and id; other attributes are data."""
    named = sorted({(a.lower(), b or c or d) for a, b, c, d in _ATTRIBUTE.findall(rest)}) if rest else ()
    return "<" + name + "".join(f" {a}={v}" for a, v in named)


@lru_cache(1 << 14)
def _child(path: str, name: str) -> str:
    """A deep path goes by its hash, so that a page of unclosed tags takes no more room than any other."""
    path = f"{path}/{name}"
    return path if len(path) < DEEP else xxhash.xxh64_hexdigest(path)


def role(path: str, token: str) -> int:
    """63 bits for a token in its path; odd for a tag, even for a word."""
    return xxhash.xxh64_intdigest(f"{path}\0{token}") >> 1 & ~1 | (token[0] == "<")


def parts(page: str):
    """(path, tag token or None, text after the tag) in the order of the page. Comments, scripts and styles have no tokens."""
    stack: list[str] = []
    paths = [""]
    opened: dict[str, int] = {}  # how often each name is in the stack

    def shut(k: int) -> None:
        for x in stack[k:]:
            opened[x] -= 1
        del stack[k:], paths[k + 1 :]

    at, tag, path = 0, None, ""  # path: the last of paths
    for m in _PART.finditer(page):
        start, end = m.span()
        name = m[2]
        if name is None:
            if start > at:
                yield path, tag, page[at:start]
                tag = None
            at = end
            continue
        if tag is not None or start > at:
            yield path, tag, page[at:start]
        at = end
        name = name.lower()
        if name[0] == "/":
            tag = _tag(name, "")
            name = name[1:]
            if opened.get(name):
                k = len(stack) - 1
                while stack[k] != name:
                    k -= 1
                shut(k)
                path = paths[-1]
        else:
            rest = m[3]
            for x in ENDS.get(name, ()):
                if opened.get(x):
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k] in ENDS[name]:
                            shut(k)
                            path = paths[-1]
                            break
                        if stack[k] in HOLDS:
                            break
                    break
            tag = _tag(name, rest)
            if name not in VOID and not rest.endswith("/"):
                # a tag's role is in its parent's path, what follows it in its own
                yield path, tag, ""
                tag = None
                stack.append(name)
                opened[name] = opened.get(name, 0) + 1
                path = _child(path, name)
                paths.append(path)
    yield path, tag, page[at:]


def bags(page: str) -> dict[str, list[str]]:
    """The tokens of the page by path."""
    out: dict[str, list[str]] = {}
    for path, tag, text in parts(page):
        if tag is not None or text:
            bag = out.setdefault(path, [])
            if tag is not None:
                bag.append(tag)
            if text:
                bag += text.split()
    return out


class Wanted:
    """Some roles: by path and token, and the paths in which a word is one of them; other words are not looked at."""

    def __init__(self, rows):
        self.by_path: dict[str, dict[str, int]] = {}
        for path, token, r in rows:
            self.by_path.setdefault(path, {})[token] = r
        self.with_words = {p for p, t in self.by_path.items() if any(x[0] != "<" for x in t)}

    def __call__(self, page: str):
        """(role or None, text before the next role) in the order of the page."""
        for path, tag, text in parts(page):
            r = self.by_path.get(path, {}).get(tag) if tag is not None else None
            if text and path in self.with_words:
                of, held = self.by_path[path], []
                for w in text.split():
                    x = of.get(w)
                    if x is None:
                        held.append(w)
                    else:
                        yield r, " ".join(held)
                        r, held = x, []
                yield r, " ".join(held)
            elif r is not None or text:
                yield r, text


# ---------------------------------------------------------------- the passes
def _keyed(pages: DataFrame) -> DataFrame:
    """Adds host, null if the URL has none, and __page, a hash that tells pages apart; repeated rows are one page."""
    host = F.lower(F.regexp_extract("url", HOST, 1))
    host = F.rtrim(host, F.lit("."))
    return pages.withColumn("host", F.when(host != "", host)).withColumn("__page", F.xxhash64("page_id", "url", "html"))


# A word's hash is the sum of its characters times powers of an odd number, mod 2^64, so that sums over all characters so far give that of any word.
_ODD, _MIX, _64 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1
_POWERS, _INVERSES = (np.cumprod(np.array([1, *[x] * (2 * BLOCK + 2)], np.uint64)) for x in (_ODD, pow(_ODD, -1, 1 << 64)))
_FIRST = _POWERS[:LONG].tolist()
_BLANK = np.array([chr(c).isspace() for c in range(0x3002)])  # no character beyond is one


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(1 << 12)
def _key(path: str) -> int:
    return xxhash.xxh64_intdigest(path.encode("utf-8", "surrogatepass"))


def bucket(path: str, token: str) -> int:
    x = sum(map(mul, map(ord, token[:LONG]), _FIRST)) + _key(path) & _64
    x = (x ^ x >> 32) * _MIX & _64
    return (x ^ x >> 32) % BUCKETS


def hashed(texts: list[str], paths: list[str]):
    """The words of the texts and bucket() of each, in blocks: a string, where in it words begin and end, the number of its text, its bucket in that text's path."""

    def block(first: int, some: list[str]):
        whole = "\n" + "\n".join(some) + "\n"
        code = _codes(whole)
        ink = ~_BLANK[np.minimum(code, len(_BLANK) - 1)]
        edges = np.flatnonzero(ink[1:] != ink[:-1]) + 1
        start, end = edges[::2], edges[1::2]
        sums = np.cumsum(code * _POWERS[: len(code)])
        h = (sums[np.minimum(end, start + LONG) - 1] - sums[start - 1]) * _INVERSES[start]
        begins = np.cumsum([1, *(len(t) + 1 for t in some)])
        n = np.diff(np.searchsorted(start, begins))  # words of each text
        keys = np.array([_key(p) for p in paths[first : first + len(some)]], np.uint64)
        x = h + np.repeat(keys, n)
        x = (x ^ x >> np.uint64(32)) * np.uint64(_MIX)
        return whole, start, end, np.repeat(np.arange(first, first + len(some)), n), ((x ^ x >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64)

    def long(i: int, text: str):
        """A text longer than a block is cut between words; one of those may be longer still."""
        at = 0
        while at < len(text):
            cut = _SPACE.search(text, at + BLOCK)
            end = cut.start() if cut else len(text)
            if end - at <= 2 * BLOCK:
                yield block(i, [text[at:end]])
            else:
                found = [(m.start(), m.end()) for m in re.finditer(r"\S+", text[at:end])]
                start, stop = np.array(found, np.int64).reshape(-1, 2).T + at
                yield text, start, stop, np.full(len(found), i), np.array([bucket(paths[i], text[at + a : at + b]) for a, b in found], np.int64)
            at = end + 1

    first, size = 0, 0
    for i, t in enumerate(texts):
        if size + len(t) > BLOCK:
            if i > first:
                yield block(first, texts[first:i])
            first, size = i, 0
            if len(t) > BLOCK:
                yield from long(i, t)
                first = i + 1
                continue
        size += len(t) + 1
    if first < len(texts):
        yield block(first, texts[first:])


def groups(pages):
    """The pages, (anything, html), in groups: what goes with each; (row in the group, path, tag) of the tags; texts, and the path and the row of each."""
    items, tags, texts, paths, rows, size = [], [], [], [], [], 0
    for item, page in pages:
        row = len(items)
        items.append(item)
        for path, tag, text in parts(page):
            if tag is not None:
                tags.append((row, path, tag))
            if text:
                texts.append(text)
                paths.append(path)
                rows.append(row)
        size += len(page)
        if size > BLOCK or len(items) == GROUP:
            yield items, tags, texts, paths, rows
            items, tags, texts, paths, rows, size = [], [], [], [], [], 0
    if items:
        yield items, tags, texts, paths, rows


class Mask:
    """Some buckets."""

    def __init__(self, buckets):
        self.at = np.zeros(BUCKETS, bool)
        self.at[buckets] = True

    def __contains__(self, b: int) -> bool:
        return bool(self.at[b])


def picked(pages):
    """(item, the page's tags and its words in wanted buckets, as bags) of pages ((mask of wanted buckets, item), html)."""
    for items, tags, texts, paths, rows in groups(pages):
        out: list[dict[str, list[str]]] = [{} for _ in items]
        for row, path, tag in tags:
            out[row].setdefault(path, []).append(tag)
        wanted, of = np.concatenate([m.at for m, _ in items]), np.array(rows, np.int64) * BUCKETS
        for whole, start, end, text, b in hashed(texts, paths):
            at = np.flatnonzero(wanted[of[text] + b])
            for i, a, z in zip(text[at].tolist(), start[at].tolist(), end[at].tolist()):
                out[rows[i]].setdefault(paths[i], []).append(whole[a:z])
        yield from zip((x for _, x in items), out)


class Tally:
    """Pages and sums of marks of the roles in wanted buckets, by host and path; a role's bucket is looked at when it is first met."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.by: dict[tuple[str, str], dict[str, list[int] | None]] = {}
        self.n = self.met = 0  # roles that are counted, and all

    def add(self, host: str, page: int, found: dict[str, list[str]], wanted) -> None:
        marks: dict[int, tuple[int, int]] = {}
        for path, bag in found.items():
            known = self.by.get((host, path))
            if known is None:
                known = self.by[host, path] = {}
            for token, n in Counter(bag).items() if len(bag) > 1 else ((bag[0], 1),):
                try:
                    x = known[token]
                except KeyError:
                    self.met += 1
                    x = known[token] = [0, 0, 0] if bucket(path, token) in wanted else None
                    self.n += x is not None
                if x is None:
                    continue
                if n not in marks:
                    h = xxhash.xxh64_intdigest(f"{page}:{n}")
                    marks[n] = h & 0xFFFFFFFF, h >> 32  # sums of 32 bits fit a bigint for 2^31 pages
                low, high = marks[n]
                x[0] += 1
                x[1] += low
                x[2] += high

    def rows(self) -> list[tuple]:
        return [(host, path, token, *x) for (host, path), known in self.by.items() for token, x in known.items() if x is not None]


class Buckets:
    """The buckets of the roles of pages; those of tags met before are kept, up to a bound."""

    def __init__(self):
        self.by_path: dict[str, dict[str, int]] = {}
        self.n = 0

    def tag(self, path: str, token: str) -> int:
        known = self.by_path.setdefault(path, {})
        b = known.get(token)
        if b is None:
            b = bucket(path, token)
            if self.n >= 1 << 20:
                self.by_path.clear()
                self.n = 0
                known = self.by_path.setdefault(path, {})
            known[token] = b
            self.n += 1
        return b

    def __call__(self, pages):
        """(item, array of buckets) of pages (item, html)."""
        for items, tags, texts, paths, rows in groups(pages):
            there = np.zeros(len(items) * BUCKETS, bool)
            there[[row * BUCKETS + self.tag(path, tag) for row, path, tag in tags]] = True
            of = np.array(rows, np.int64) * BUCKETS
            for _, _, _, text, b in hashed(texts, paths):
                there[of[text] + b] = True
            found = np.flatnonzero(there)
            ends = np.searchsorted(found, np.arange(1, len(items) + 1) * BUCKETS).tolist()
            at = 0
            for row, (item, end) in enumerate(zip(items, ends)):
                yield item, (found[at:end] - row * BUCKETS).astype(np.uint16)
                at = end


def _frequent(pages: DataFrame, minimum: DataFrame) -> DataFrame:
    """host, t: its buckets with a role on enough of its pages to hold a frequent one, as an array; stored.

    Each task sends a vector of counts for each of its hosts, and those of a host are added up in tasks of at most FAN.
    """

    def vector(host: str, n: np.ndarray):
        at = np.flatnonzero(n)
        return host, np.uint32(len(at)).tobytes() + at.astype(np.uint16).tobytes() + packed(n[at])

    def batch(rows):
        ids = np.frombuffer(os.urandom(8 * len(rows)), np.int64)
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()), pa.array(ids), pa.array([v for _, v in rows], pa.binary())], ["host", "id", "n"])

    def run(batches):
        buckets, seen, held = Buckets(), {}, 0

        def flush():
            rows = [vector(h, np.bincount(np.concatenate(x), minlength=BUCKETS)) for h, x in seen.items()]
            seen.clear()
            return batch(rows)

        for b in batches:
            for host, found in buckets(zip(b.column("host").to_pylist(), b.column("html").to_pylist())):
                seen.setdefault(host, []).append(found)
                held += len(found)
                if held > FLUSH:
                    yield flush()
                    held = 0
        yield flush()

    def opened(data: bytes, total: np.ndarray) -> None:
        raw = np.frombuffer(data, np.uint8)
        n = int(raw[:4].view(np.uint32)[0])
        total[raw[4 : 4 + 2 * n].view(np.uint16)] += unpacked(raw[4 + 2 * n :], n)[0]

    def add(key, t):
        total = np.zeros(BUCKETS, np.int64)
        for x in t["n"].to_pylist():
            opened(x, total)
        return pa.Table.from_batches([batch([vector(key[0].as_py(), total)])])

    def enough(key, t):
        total = np.zeros(BUCKETS, np.int64)
        for x in t["n"].to_pylist():
            opened(x, total)
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "t": pa.array([np.flatnonzero(total >= t["least"][0].as_py()).astype(np.int32)], pa.list_(pa.int32()))})

    rows = stored(pages.select("host", "html").mapInArrow(run, "host string, id bigint, n binary"), "tp-counted")
    most = rows.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while most > FAN:
        salt = F.pmod(F.xxhash64("id"), F.lit(-(-most // FAN)))
        rows = stored(rows.withColumn("salt", salt).groupBy("host", "salt").applyInArrow(add, "host string, id bigint, n binary"), "tp-added")
        most = -(-most // FAN)
    return stored(rows.join(minimum, "host").groupBy("host").applyInArrow(enough, "host string, t array<int>").where("size(t) > 0"), "tp-buckets")


def _with(pages: DataFrame, rows: DataFrame, run, schema: str, columns=("host", "__page", "html")) -> DataFrame:
    """mapInArrow over the pages with a table by host: run(batches, lookup), lookup(host, row) -> the rows of the host.

    rows: host, t (an array of structs) and bytes (what it takes). It is broadcast while small; beyond, its rows travel with the pages.
    """
    rows = stored(rows, "tp-table")
    size = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    rows = rows.drop("bytes")
    if size <= BROADCAST_LIMIT:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: [tuple(x) for x in r["t"]] for r in rows.collect()})
        return pages.select(*columns).mapInArrow(lambda batches: run(batches, lambda host, _: shared.value.get(host)), schema)
    joined = pages.join(rows, "host", "left").select(*columns, "t")
    return joined.mapInArrow(lambda batches: run(batches, lambda host, t: None if t is None else [tuple(x.values()) for x in t]), schema)


def _bytes():
    """What the template rows of a host take in Python."""
    return F.sum(F.octet_length("path") + F.octet_length("token") + 400).alias("bytes")


def _rows_of(b):
    """(row number, host, page, html, its table rows) of a batch."""
    names = b.schema.names
    t = b.column("t").to_pylist() if "t" in names else [None] * b.num_rows
    return zip(range(b.num_rows), b.column("host").to_pylist(), b.column("__page").to_pylist(), b.column("html").to_pylist(), t)


class Lookup:
    """What a host's table says, made once for each host."""

    def __init__(self, make):
        self.make, self.held = make, {}

    def __call__(self, host, rows):
        if host not in self.held:
            if len(self.held) > 2000:
                self.held.clear()
            self.held[host] = self.make(rows)
        return self.held[host]


def _counts(pages: DataFrame, frequent: DataFrame, minimum: DataFrame) -> DataFrame:
    """host, path, token, role, class (of the occurrence vector) of the roles frequent in all pages."""

    def run(batches, lookup):
        held = Lookup(lambda rows: Mask([b for (b,) in rows]))
        total = Tally()

        def wanted(b):
            for _, host, page, text, t in _rows_of(b):
                rows = lookup(host, t)
                if rows is not None:
                    mask = held(host, rows)
                    yield (mask, (host, page, mask)), text

        for b in batches:
            for (host, page, mask), found in picked(wanted(b)):
                total.add(host, page, found, mask)
                if total.n > FLUSH or total.met > 2 * FLUSH:
                    yield from rows_of(total)
                    total.clear()
        yield from rows_of(total)

    def rows_of(total):
        found = total.rows()
        for i in range(0, len(found), 1 << 16):
            x = found[i : i + (1 << 16)]
            columns = [pa.array(c, pa.string() if j < 3 else pa.int64()) for j, c in enumerate(zip(*x))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([role(p, t) for _, p, t, *_ in x], pa.int64())], ["host", "path", "token", "n", "m1", "m2", "role"])

    per_host = frequent.select("host", F.transform("t", lambda b: F.struct(b)).alias("t"), (F.size("t") * 100).alias("bytes"))
    counted = _with(pages, per_host, run, "host string, path string, token string, n bigint, m1 bigint, m2 bigint, role bigint")
    sums = counted.groupBy("host", "path", "token", "role").agg(F.sum("n").alias("n"), F.sum("m1").alias("m1"), F.sum("m2").alias("m2"))
    return sums.join(minimum, "host").where("n >= least").select("host", "path", "token", "role", F.xxhash64("n", "m1", "m2").alias("class"))


def spans(found: list[tuple[int, int]], classes: dict[int, int]):
    """Of a page's template tokens (role, place), in order: what each class looks like on it.

    {class: ({role: rank}, parent, crossed)}. rank: the place of a tag among the class's tags in each repetition, of a word the gap
    between tags and its place among the words of the gap; None if repetitions differ. parent: (class, role of the tag before).
    """
    by: dict[int, list[int]] = {}
    for i, (r, _) in enumerate(found):
        by.setdefault(classes[r], []).append(i)
    ranks: dict[int, dict[int, int | None]] = {}
    bounds: dict[int, list[tuple[int, int]]] = {}
    for c, at in by.items():
        tags = [i for i in at if found[i][0] & 1]
        words = [i for i in at if not found[i][0] & 1]
        lead = tags or at
        kinds = {found[i][0] for i in lead}
        k = len(kinds)
        rank: dict[int, int | None] = {}
        for n, i in enumerate(lead):
            r = found[i][0]
            if rank.setdefault(r, n % k) != n % k:
                rank[r] = None
        if len(set(rank.values())) < k:  # two tags with one rank, or some that move
            seen = Counter(v for v in rank.values() if v is not None)
            rank = {r: v if v is not None and seen[v] == 1 else None for r, v in rank.items()}
        if tags and words:
            j, inner, gap_before = 0, 0, -1
            for i in words:
                while j < len(tags) and tags[j] < i:
                    j += 1
                inner = inner + 1 if j == gap_before else 0
                gap_before = j
                gap = -1 if j == 0 or j == len(tags) else (j - 1) % k
                value = None if gap < 0 or gap == k - 1 else gap + 1 << WORDS | inner
                r = found[i][0]
                if rank.setdefault(r, value) != value:
                    rank[r] = None
        ranks[c] = rank
        bounds[c] = [(lead[n], lead[min(n + k, len(lead)) - 1]) for n in range(0, len(lead), k)]
    # repetitions as intervals, outer ones first; a stack tells in which one lies
    every = sorted((a, -b, c) for c, bs in bounds.items() for a, b in bs)
    parent: dict[int, tuple[int, int] | None] = {}
    crossed: set[int] = set()
    stack: list[tuple[int, int, int]] = []
    for a, b, c in every:
        b = -b
        while stack and stack[-1][1] < a:
            stack.pop()
        if stack and stack[-1][1] < b:
            crossed.add(c)
        up = None
        if stack:
            s, _, d = stack[-1]
            if d == c:
                crossed.add(c)
            before = [i for i in by[d] if s <= i < a and found[i][0] & 1] or [s]
            up = (d, found[before[-1]][0])
            # all of it must be in one gap
            if any(a < i < b for i in by[d]):
                crossed.add(c)
        if parent.setdefault(c, up) != up:
            crossed.add(c)
        stack.append((a, b, c))
    return {c: (ranks[c], parent[c], c in crossed) for c in by}


def _validated(pages: DataFrame, classes: DataFrame) -> DataFrame:
    """host, role, class, rank of the valid tokens of valid classes, and up, up_role: what their class is nested in (null: the page)."""

    def run(batches, lookup):
        held = Lookup(lambda rows: (Wanted([x[:3] for x in rows]), {r: c for _, _, r, c in rows}))
        token: dict[tuple, int | None] = {}
        nest: dict[tuple, tuple | None] = {}
        bad = (0, 0)
        for b in batches:
            for _, host, _, text, t in _rows_of(b):
                rows = lookup(host, t)
                if rows is None:
                    continue
                wanted, of = held(host, rows)
                for c, (rank, up, crossed) in spans([(r, i) for i, (r, _) in enumerate(wanted(text)) if r is not None], of).items():
                    for r, v in rank.items():
                        if token.setdefault((host, r), v) != v:
                            token[host, r] = None
                    mine = bad if crossed else up
                    if nest.setdefault((host, c), mine) != mine:
                        nest[host, c] = bad
        out = [(h, 0, r, v, v is None, None, None) for (h, r), v in token.items()] + [(h, 1, c, None, up == bad, *(up or (None, None))) for (h, c), up in nest.items()]
        for i in range(0, len(out), 1 << 16):
            cols = list(zip(*out[i : i + (1 << 16)]))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], ["host", "kind", "key", "rank", "bad", "up", "up_role"])

    per_host = classes.groupBy("host").agg(F.collect_list(F.struct("path", "token", "role", "class")).alias("t"), _bytes())
    seen = stored(_with(pages, per_host, run, "host string, kind int, key bigint, rank bigint, bad boolean, up bigint, up_role bigint"), "tp-seen")
    tokens = seen.where("kind = 0").groupBy("host", F.col("key").alias("role")).agg(F.min("rank").alias("rank"), F.max("rank").alias("most"), F.bool_or("bad").alias("bad")).where("not bad and rank = most").select("host", "role", "rank")
    up = F.struct("up", "up_role")
    nests = seen.where("kind = 1").groupBy("host", F.col("key").alias("class")).agg(F.min(up).alias("u"), F.max(up).alias("v"), F.bool_or("bad").alias("bad")).where("not bad and u = v").select("host", "class", "u.up", "u.up_role")
    # a class needs a tag pair to enclose slots: two valid tags
    good = classes.join(tokens, ["host", "role"]).join(nests, ["host", "class"])
    big = good.groupBy("host", "class").agg(F.count_if(F.col("role").bitwiseAND(F.lit(1)) == 1).alias("tags")).where("tags >= 2").select("host", "class")
    return good.join(big, ["host", "class"])


def deduced(pages: DataFrame) -> DataFrame:
    """host, path, token, role, class, rank, up, up_role of the template tokens of every host with enough pages; stored."""
    usable = _keyed(pages.select("page_id", "url", "html")).where("host is not null and length(html) > 0")
    ship(pages.sparkSession)
    n = usable.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    minimum = stored(n.select("host", F.greatest(F.lit(MIN_PAGES), F.ceil(F.col("n") * SUPPORT)).alias("least")), "tp-hosts")
    counted = stored(_counts(usable, _frequent(usable, minimum), minimum), "tp-counts")
    size = counted.groupBy("host", "class").count().where("count >= 2").select("host", "class")
    classes = stored(counted.join(size, ["host", "class"]), "tp-classes")
    return stored(_validated(usable, classes), "tp-template")


def slots_of(page: str, wanted: Wanted, ranks: dict[int, tuple[int, int]]) -> tuple[int, list[tuple[str, str]]]:
    """Number of template tokens on the page, and (slot, text) of each piece of text between them.

    ranks: role -> (number of its class, rank). A slot is named by the class and rank of the template token before it; a word's rank
    is that of the gap it is in and its place there.
    """
    n, name, out, held = 0, "", [], []

    def close():
        text = " ".join(" ".join(held).split())
        if text:
            out.append((name, entities.unescape(text)))
        held.clear()

    for r, text in wanted(page):
        if r is not None:
            close()
            n += 1
            c, rank = ranks[r]
            name = f"{c}.{rank}" if rank < 1 << WORDS else f"{c}.{(rank >> WORDS) - 1}.{rank & (1 << WORDS) - 1}"
        if text:
            held.append(text)
    close()
    return n, out


def extracted(pages: DataFrame, template: DataFrame | None = None) -> DataFrame:
    """page_id, host, n_template (template tokens on the page), slots (array of slot and text) and text (the slots' texts by line) of every row.

    Hosts with fewer than MIN_PAGES pages have no template: their pages are one slot, "". So it is where the URL is null, empty or without a host
    (host null). A null html gives null slots and text, an empty one none. Repeated rows count as pages of their own, and all stay; whole pages are
    read whatever their length; classes are numbered by their least role, so that ties change nothing; other columns are
    ignored; an empty table gives an empty result.
    """
    ship(pages.sparkSession)
    template = deduced(pages) if template is None else template
    keyed = _keyed(pages.select("page_id", "url", "html"))
    kind = pa.list_(pa.struct([("slot", pa.string()), ("text", pa.string())]))

    def table(rows):
        least: dict[int, int] = {}
        for _, _, r, c, _ in rows:
            least[c] = min(r, least.get(c, r))
        number = {c: i for i, c in enumerate(sorted(least, key=least.get))}
        return Wanted([x[:3] for x in rows]), {r: (number[c], rank) for _, _, r, c, rank in rows}

    def run(batches, lookup):
        held, nothing = Lookup(table), Wanted([])
        for b in batches:
            n, slots, text = [], [], []
            for _, host, _, page, t in _rows_of(b):
                if page is None:
                    n.append(0), slots.append(None), text.append(None)
                    continue
                rows = lookup(host, t) if host is not None else None
                k, found = slots_of(page, *(held(host, rows) if rows else (nothing, {})))
                n.append(k)
                slots.append([{"slot": s, "text": x} for s, x in found])
                text.append("\n".join(x for _, x in found))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), pa.array(n, pa.int32()), pa.array(slots, kind), pa.array(text, pa.string())], ["page_id", "host", "n_template", "slots", "text"])

    per_host = template.groupBy("host").agg(F.collect_list(F.struct("path", "token", "role", "class", "rank")).alias("t"), _bytes())
    schema = f"page_id {keyed.schema['page_id'].dataType.simpleString()}, host string, n_template int, slots array<struct<slot:string,text:string>>, text string"
    return _with(keyed, per_host, run, schema, ("page_id", "host", "__page", "html"))
