"""Benchmark decontamination by pigeonhole edit matching.

Texts are reduced to lower-case words with single blanks, one before the first and one after the last word; so is an item, so that it begins
and ends where words do, or else pays for it. An item of m bytes may differ from a passage by k = rate x m edits; cut into k + 1 pieces, it leaves one piece whole wherever it occurs so. All positions of all documents are compared with the
pieces' first 8 bytes at once, hits are held against the whole piece, and the passage around a hit is verified with
Myers' bit-parallel edit distance, over integers as long as the item.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .common import slices, utf8

ERROR_RATE = 0.06
LEAST = 16  # bytes of an item's words; shorter ones are in texts that have nothing to do with them
SHARD_BYTES = 16 << 20  # of items that are matched in one pass

_U = np.uint64
_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def normalised(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts in one run, a blank before, between and after the words of a text, a zero byte after it; and where each begins."""
    n = len(offsets) - 1
    buf = np.full(len(raw) + 3 * n, 32, np.uint8)
    body = _FOLD[raw]
    if len(raw) > 1:
        capital = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        body[1:][capital] += 0x20
    buf[np.arange(len(raw)) + np.repeat(3 * np.arange(n) + 1, np.diff(offsets))] = body
    ends = offsets[1:] + 3 * np.arange(n) + 2
    buf[ends] = 0
    blank = buf == 32
    keep = np.ones(len(buf), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return buf[keep], np.concatenate([[0], np.cumsum(keep)[ends]])


def normal(text: str) -> bytes:
    """The words of a text with a blank before and after each; one blank if there are none."""
    raw, off = utf8(pa.array([text], pa.string()))
    return normalised(raw, off)[0][:-1].tobytes()


def eights(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number; bytes after the end are 0."""
    x = np.zeros(len(buf) + 8, _U)
    x[: len(buf)] = buf
    for step in (1, 2, 4):
        y = x[: len(x) - step] << _U(8 * step)
        y |= x[step:]
        x = y
    return x[: len(buf)]


class Pattern:
    """An item ready for Myers' algorithm."""

    def __init__(self, item: bytes):
        self.item, self.m = item, len(item)
        self.peq: dict[int, int] = {}
        for i, c in enumerate(item):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def distance(self, text: bytes) -> int:
        """The least edit distance of the item to any substring of text."""
        m, peq = self.m, self.peq
        mask, high = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score, best = mask, 0, m, m
        for c in text:
            eq = peq.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (~(xh | pv) & mask)
            mh = pv & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
                if score < best:
                    best = score
            ph <<= 1
            pv = ((mh << 1) | (~(xv | ph) & mask)) & mask
            mv = ph & xv & mask
        return best


@dataclass
class Index:
    patterns: list[Pattern]
    ids: list[int | None]
    budget: list[int]
    first: np.ndarray  # sorted first 8 bytes of the pieces of at least 8 bytes
    item: np.ndarray  # and the item, offset and length of each
    offset: np.ndarray
    length: np.ndarray
    table: np.ndarray
    short: list[tuple[int, int, bytes]]  # pieces of under 8 bytes: item, offset, bytes


HASH_BITS = 20


def _slot(x: np.ndarray) -> np.ndarray:
    return ((x * _U(0x9E3779B97F4A7C15)) >> _U(64 - HASH_BITS)).astype(np.intp)


def budget_of(item: bytes, rate: float = ERROR_RATE) -> int:
    """How many bytes may differ, the blanks around the words not counted."""
    return int(rate * (len(item) - 2))


def index(items: list[tuple[int | None, str]], rate: float = ERROR_RATE, least: int = LEAST) -> Index:
    patterns, ids, budget, pieces, short = [], [], [], [], []
    for item_id, text in items:
        item = normal(text) if text else b""
        if len(item) - 2 < max(least, 1):
            continue
        k = budget_of(item, rate)
        n = len(patterns)
        patterns.append(Pattern(item))
        ids.append(item_id)
        budget.append(k)
        cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a < 8:
                short.append((n, a, item[a:b]))
            else:
                pieces.append((int.from_bytes(item[a : a + 8], "big"), n, a, b - a))
    pieces.sort()
    cols = list(zip(*pieces)) if pieces else [(), (), (), ()]
    first = np.array(cols[0], _U)
    table = np.zeros(1 << HASH_BITS, bool)
    table[_slot(first)] = True
    return Index(patterns, ids, budget, first, *(np.array(c, np.int64) for c in cols[1:]), table, short)


def matches(ix: Index, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, item, distance) of every item that occurs in a text within its budget; distance is the least."""
    buf, start = normalised(raw, offsets)
    data = buf.tobytes()
    seeds: list[tuple[int, int]] = []  # item, where it would begin
    if len(ix.first):
        code = eights(buf)
        at = np.flatnonzero(ix.table[_slot(code)])
        lo, hi = np.searchsorted(ix.first, code[at], "left"), np.searchsorted(ix.first, code[at], "right")
        while (more := lo < hi).any():
            at, lo, hi = at[more], lo[more], hi[more]
            length = ix.length[lo]
            inside = at + length <= len(buf)
            tail = code[np.where(inside, at + length - 8, 0)]
            want = _last(ix)[lo]
            for p, piece in zip(at[inside & (tail == want)], lo[inside & (tail == want)]):
                n, a, size = int(ix.item[piece]), int(ix.offset[piece]), int(ix.length[piece])
                if size <= 16 or data[p : p + size] == ix.patterns[n].item[a : a + size]:
                    seeds.append((n, int(p) - a))
            lo = lo + 1
    for n, a, piece in ix.short:
        p = data.find(piece)
        while p >= 0:
            seeds.append((n, p - a))
            p = data.find(piece, p + 1)
    best: dict[tuple[int, int], int] = {}
    reach: dict[tuple[int, int], int] = {}  # up to where the places of an item in a text were verified
    for n, p in sorted(set(seeds)):
        pattern, k = ix.patterns[n], ix.budget[n]
        anchor = min(max(p, 0), len(data) - 1)
        d = int(np.searchsorted(start, min(max(p + pattern.m // 2, 0), len(data) - 1), "right")) - 1
        if not start[d] <= anchor < start[d + 1] and k == 0:
            continue
        for doc in {d, int(np.searchsorted(start, anchor, "right")) - 1}:
            key = (doc, n)
            if best.get(key) == 0 or p <= reach.get(key, -(1 << 60)):
                continue
            if data[max(p, 0) : p + pattern.m] == pattern.item:
                best[key] = 0
                continue
            if k == 0:
                continue
            a, b = max(p - k, int(start[doc])), min(p + pattern.m + 2 * k, int(start[doc + 1]) - 1)
            dist = pattern.distance(data[a:b]) if b > a else k + 1
            reach[key] = p + k // 2 if dist > k else p
            if dist <= k:
                best[key] = min(dist, best.get(key, dist))
    return [(d, n, dist) for (d, n), dist in best.items()]


def _last(ix: Index) -> np.ndarray:
    """The last 8 bytes of each piece."""
    if not hasattr(ix, "_tail"):
        ix._tail = np.array([int.from_bytes(ix.patterns[n].item[a + s - 8 : a + s], "big") for n, a, s in zip(ix.item, ix.offset, ix.length)], _U)
    return ix._tail


def _shards(benchmark: DataFrame) -> list[list[tuple[int | None, str]]]:
    """The items in parts that can be broadcast: one as a rule, read from the cluster one after the other if there are more."""
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-size // SHARD_BYTES))
    if n == 1:
        yield [(r["item_id"], r["text"]) for r in items.collect()]
        return
    for i in range(n):
        yield [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).collect()]


def _matcher(spark: SparkSession, items, rate: float, least: int):
    """A column function: text -> array of (item_id, distance)."""
    ship(spark)
    shared = spark.sparkContext.broadcast(index(sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])), rate, least))

    def run(text: pa.Array) -> pa.Array:
        ix = shared.value
        raw, off = utf8(text)
        out: list[list] = [[] for _ in range(len(text))]
        for i, j in slices(off, 5000, 1 << 20):
            for d, n, dist in matches(ix, raw[off[i] : off[j]], off[i : j + 1] - off[i]):
                out[i + d].append({"item_id": ix.ids[n], "distance": dist})
        return pa.array(out, pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())])))

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<struct<item_id:bigint,distance:int>>")


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, least: int = LEAST) -> DataFrame:
    """doc_id, item_id, distance (bytes, of the best passage) for every document and item it holds within the budget.

    An item occurs where its words do, from the beginning of one to the end of one; a letter more or less there is an edit. Items with a null or
    empty text, and of fewer than least bytes in words, match nothing; texts without words hold nothing. Repeated
    documents give a row each; items with one text and several ids each match. Whole texts are
    searched; other columns are ignored; empty tables give an empty result.
    """
    out = None
    for items in _shards(benchmark):
        f = _matcher(docs.sparkSession, items, rate, least)
        part = docs.select("doc_id", F.explode(f(F.col("text"))).alias("m")).select("doc_id", "m.item_id", "m.distance")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, least: int = LEAST) -> DataFrame:
    """The rows, with their columns as they were, that hold no item within the budget.

    Rows with a null text, or one without words, stay; repeated rows stay or go together; whole texts are searched; without items, or
    without any of least bytes, all stay; an empty table stays empty.
    """
    for items in _shards(benchmark):
        f = _matcher(docs.sparkSession, items, rate, least)
        docs = docs.withColumn("__loom_hits", f(F.col("text"))).where(F.size("__loom_hits") == 0).drop("__loom_hits")
    return docs
