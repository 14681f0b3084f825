"""Scoring with a byte n-gram model kept in an Elias-Fano trie.

Counts of the n-grams of UTF-8 bytes of all documents are gathered by Spark (N zero bytes before and after each text
mark its ends), smoothed by interpolated Witten-Bell, quantised to 8 bits by equal-frequency bins, and stored as a
trie with one level per order. A level holds, for its nodes in the order of their n-grams,
  - last bytes, made monotone by adding 256 x the rank of the parent: an Elias-Fano sequence, and
  - codes of log p(byte | context) and, but for the last level, of the back-off weight of the node as a context.
A node's children are found relative to their context: those of node r of the level before are the entries of
[256 r, 256 r + 256), so one successor search of 256 r + byte in the monotone sequence both finds the range and answers.
The pointers of the parent, themselves monotone, are the second Elias-Fano sequence of a level and bound the search.
The trie is kept in shards by a hash of the two leading bytes, each with all single bytes as its first level; they are files in
the shared folder that the workers map into memory.
"""

from __future__ import annotations

import json
import math
import os
import struct
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import fresh_path, ship, stored
from .common import mix64, slices, utf8

ORDER = 6
BINS = 256
SHARDS = 8  # at least, and
SHARD_NODES = 4 << 20  # so many nodes to a shard, but that all with one pair of leading bytes are together


# ---------------------------------------------------------------- Elias-Fano
class EliasFano:
    """A non-decreasing sequence; access and successor search work on whole arrays of queries."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, rank: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.rank = n, low_bits, low, high, rank

    @staticmethod
    def build(values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        v = values.astype(np.uint64)
        bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        # low parts, bit by bit in one stream of 64-bit words
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        if bits and n:
            part = v & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << off)
            over = off + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - off[over]))
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(((int(at[-1]) + 1 if n else 0) + 63) // 64 * 64 + 64, np.uint8)
        flags[at] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        rank = np.zeros(len(high) + 1, np.uint32 if n < 1 << 32 else np.uint64)
        rank[1:] = np.cumsum(np.bitwise_count(high))
        return EliasFano(n, bits, low, high, rank)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at positions i."""
        i = i.astype(np.int64)
        word = np.searchsorted(self.rank, i, "right") - 1
        left = (i - self.rank[word].astype(np.int64)).astype(np.int64)
        w = self.high[word]
        pos = np.zeros(len(i), np.int64)
        for width in (32, 16, 8, 4, 2, 1):  # the left-th set bit of w
            part = (w >> pos.astype(np.uint64)) & np.uint64((1 << width) - 1)
            c = np.bitwise_count(part).astype(np.int64)
            right = left >= c
            left -= np.where(right, c, 0)
            pos += np.where(right, width, 0)
        out = (word * 64 + pos - i).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            at = i.astype(np.uint64) * np.uint64(self.low_bits)
            k, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            x = self.low[k] >> off
            over = off + np.uint64(self.low_bits) > np.uint64(64)
            x = np.where(over, x | (self.low[k + 1] << ((np.uint64(64) - off) & np.uint64(63))), x)
            out |= x & np.uint64((1 << self.low_bits) - 1)
        return out.astype(np.int64)

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first position in [lo, hi) whose value is at least x, else hi."""
        lo, hi = lo.astype(np.int64).copy(), hi.astype(np.int64).copy()
        while (act := lo < hi).any():
            mid = (lo + hi) >> 1
            v = np.zeros(len(x), np.int64)
            v[act] = self.get(mid[act])
            less = act & (v < x)
            lo = np.where(less, mid + 1, lo)
            hi = np.where(act & ~less, mid, hi)
        return lo

    def to_bytes(self) -> bytes:
        head = struct.pack("<6q", self.n, self.low_bits, len(self.low), len(self.high), len(self.rank), self.rank.itemsize)
        pad = b"\0" * (-(len(self.rank) * self.rank.itemsize) % 8)
        return head + self.low.tobytes() + self.high.tobytes() + self.rank.tobytes() + pad

    @staticmethod
    def from_buffer(buf: np.ndarray, at: int) -> tuple[EliasFano, int]:
        n, bits, a, b, c, size = struct.unpack("<6q", buf[at : at + 48].tobytes())
        at += 48
        low = buf[at : at + 8 * a].view(np.uint64)
        high = buf[at + 8 * a : at + 8 * (a + b)].view(np.uint64)
        at += 8 * (a + b)
        rank = buf[at : at + size * c].view(np.uint32 if size == 4 else np.uint64)
        return EliasFano(n, bits, low, high, rank), at + size * c + (-(size * c) % 8)


# ---------------------------------------------------------------- trie
class Trie:
    """The levels 1 to N of one shard; nodes are numbered within their level in n-gram order."""

    def __init__(self, levels: list[tuple[EliasFano, EliasFano, np.ndarray, np.ndarray]]):
        self.levels = levels

    @staticmethod
    def build(codes: list[np.ndarray], prob: list[np.ndarray], back: list[np.ndarray]) -> Trie:
        """codes[k]: the sorted codes of the (k + 1)-grams, each of whose prefixes is in the level before."""
        levels, parents = [], np.zeros(1, np.uint64)
        for k, code in enumerate(codes):
            parent = np.searchsorted(parents, code >> np.uint64(8)).astype(np.int64) if k else np.zeros(len(code), np.int64)
            mono = parent * 256 + (code & np.uint64(255)).astype(np.int64)
            starts = np.searchsorted(parent, np.arange(len(parents) + 1))
            levels.append((EliasFano.build(starts, len(code) + 1), EliasFano.build(mono, len(parents) * 256), prob[k].astype(np.uint8), back[k].astype(np.uint8)))
            parents = code
        return Trie(levels)

    def walk(self, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For k-grams: the node of each, -1 where there is none, and that of its first k - 1 bytes."""
        node = np.zeros(len(codes), np.int64)
        before = node
        for j in range(k):
            before = node
            byte = ((codes >> np.uint64(8 * (k - 1 - j))) & np.uint64(255)).astype(np.int64)
            pointers, mono = self.levels[j][:2]
            ok = np.flatnonzero(node >= 0)
            new = np.full(len(codes), -1, np.int64)
            lo, hi = pointers.get(node[ok]), pointers.get(node[ok] + 1)
            want = node[ok] * 256 + byte[ok]
            at = mono.successor(want, lo, hi)
            hit = at < hi
            hit[hit] = mono.get(at[hit]) == want[hit]
            new[ok[hit]] = at[hit]
            node = new
        return node, before

    def to_bytes(self) -> bytes:
        out = [struct.pack("<q", len(self.levels))]
        for a, b, p, w in self.levels:
            out += [a.to_bytes(), b.to_bytes()]
            for x in (p, w):
                out += [struct.pack("<q", len(x)), x.tobytes(), b"\0" * (-len(x) % 8)]
        return b"".join(out)

    @staticmethod
    def from_buffer(buf: np.ndarray) -> Trie:
        (n,), at, levels = struct.unpack("<q", buf[:8].tobytes()), 8, []
        for _ in range(n):
            a, at = EliasFano.from_buffer(buf, at)
            b, at = EliasFano.from_buffer(buf, at)
            arrays = []
            for _ in range(2):
                (m,) = struct.unpack("<q", buf[at : at + 8].tobytes())
                arrays.append(buf[at + 8 : at + 8 + m])
                at += 8 + m + (-m % 8)
            levels.append((a, b, *arrays))
        return Trie(levels)


# ---------------------------------------------------------------- counting
def windows(raw: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of so many bytes over 0^N text 0^N, one text after the other, and where each text's begin."""
    n, pad = len(offsets) - 1, order
    size = np.diff(offsets)
    start = np.concatenate([[0], np.cumsum(size + 2 * pad)])
    buf = np.zeros(int(start[-1]) + order, np.uint8)
    buf[np.arange(len(raw)) + np.repeat((2 * np.arange(n) + 1) * pad, size)] = raw
    code = np.zeros(int(start[-1]), np.uint64)
    for i in range(order):
        code = (code << np.uint64(8)) | buf[i : i + len(code)]
    return code, start


def distinct(code: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and how often, or with what total, each is there."""
    if not len(code):
        return code, np.zeros(0, np.int64)
    if count is None:
        code = np.sort(code)
    else:
        order = np.argsort(code, kind="stable")
        code, count = code[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    n = np.diff(np.append(first, len(code))) if count is None else np.add.reduceat(count, first)
    return code[first], n


def _count(order: int):
    def run(batches):
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            code, n = distinct(np.concatenate([c for c, _ in parts]), np.concatenate([m for _, m in parts])) if len(parts) > 1 else parts[0]
            return [(code, n)]

        for b in batches:
            raw, off = utf8(b.column(0))
            valid = np.asarray(b.column(0).is_valid())
            for i, j in slices(off, 100_000, 8 << 20):
                code, start = windows(raw[off[i] : off[j]], off[i : j + 1] - off[i], order)
                # a window that starts in the zeros after a text is not counted, nor are those of a null
                keep = np.ones(len(code), bool)
                for p in range(order):
                    keep[start[1:] - 1 - p] = False
                for d in np.flatnonzero(~valid[i:j]):
                    keep[start[d] : start[d + 1]] = False
                parts.append(distinct(code[keep]))
                if len(parts) >= 8:
                    parts[:] = merged()
        if parts:
            (code, n), *_ = merged()
            for i in range(0, len(code), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(code[i : i + (1 << 17)].astype(np.int64)), pa.array(n[i : i + (1 << 17)].astype(np.int64))], ["code", "n"])

    return run


def counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """code, n: the N-grams of all texts; the first byte of the gram is the highest of the code."""
    ship(docs.sparkSession)
    return docs.select("text").mapInArrow(_count(order), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def smoothed(top: DataFrame, order: int = ORDER) -> DataFrame:
    """k, code, lp (log p of the last byte), bow (log weight of backing off from it): all orders, interpolated.

    p_k(c | h) = (n(hc) + t(h) p_{k-1}(c | h')) / (n(h) + t(h)), h' without its first byte, t(h) the number of bytes
    that follow h; p_0 = 1/256. Each order is one aggregation of the next and two equi-joins on prefix and suffix.
    """
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        levels[k] = levels[k + 1].groupBy(F.shiftright("code", 8).alias("code")).agg(F.sum("n").alias("n"), F.count("*").alias("t"))
    empty = levels[1].agg(F.sum("n").alias("hn"), F.count("*").alias("ht"))
    done = {}
    one = levels[1].crossJoin(F.broadcast(empty))
    done[1] = one.withColumn("p", (F.col("n") + F.col("ht") / 256.0) / (F.col("hn") + F.col("ht")))
    for k in range(2, order + 1):
        ctx = levels[k - 1].select(F.col("code").alias("h"), F.col("n").alias("hn"), F.col("t").alias("ht"))
        low = done[k - 1].select(F.col("code").alias("s"), F.col("p").alias("lp"))
        mask = (1 << (8 * (k - 1))) - 1
        x = levels[k].withColumn("h", F.shiftright("code", 8)).withColumn("s", F.col("code").bitwiseAND(F.lit(mask)))
        # h and s are counted wherever hc is, but for the grams over the ends of texts, whose suffix may be missing
        x = x.join(ctx, "h").join(low, "s", "left").withColumn("lp", F.coalesce("lp", F.lit(1 / 256.0)))
        done[k] = stored(x.select("code", "n", *(["t"] if k < order else []), ((F.col("n") + F.col("ht") * F.col("lp")) / (F.col("hn") + F.col("ht"))).alias("p")), f"lm{k}")
    out = None
    for k in range(1, order + 1):
        bow = F.log(F.col("t") / (F.col("n") + F.col("t"))) if k < order else F.lit(0.0)
        d = done[k].select(F.lit(k).alias("k"), "code", F.log("p").alias("lp"), bow.alias("bow"))
        out = d if out is None else out.unionByName(d)
    return out


# ---------------------------------------------------------------- storing
def _local(uri: str) -> str:
    u = urlparse(uri)
    if u.scheme not in ("", "file"):
        raise RuntimeError("the model's levels are mapped into memory: spark.checkpoint.dir must be a mounted folder (file://)")
    return u.path


def _shard(lead, shards: int):
    """The shard of grams of two bytes or more by the number of the first two."""
    return ((lead * 40503) % 65536) * shards // 65536


def build(docs: DataFrame, order: int = ORDER) -> str:
    """Count, smooth, quantise and write the trie; returns its folder. One file a shard."""
    spark = docs.sparkSession
    ship(spark)
    top = stored(counts(docs, order), "lmtop")
    grams = stored(smoothed(top, order), "lmgrams")
    # equal-frequency bins from all nodes: their values rounded to 1/256 nats and counted
    hist = grams.groupBy("k", F.round(F.col("lp") * 256).cast("int").alias("v")).count().collect()
    bhist = grams.where(F.col("k") < order).groupBy("k", F.round(F.col("bow") * 256).cast("int").alias("v")).count().collect()
    shards = max(SHARDS, -(-sum(r["count"] for r in hist) // SHARD_NODES))
    books = {"p": _books(hist, order), "b": _books(bhist, order)}
    folder = fresh_path(spark, "lmtrie")
    path = _local(folder)
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "books.json"), "w") as f:
        json.dump({"order": order, "shards": shards, **books}, f)

    def write(key, t):
        k = t["k"].to_numpy()
        code = t["code"].to_numpy().astype(np.uint64)
        p, b = t["lp"].to_numpy(), t["bow"].to_numpy()
        codes, prob, back = [], [], []
        for j in range(1, order + 1):
            at = np.flatnonzero(k == j)
            at = at[np.argsort(code[at])]
            codes.append(code[at])
            prob.append(quantise(p[at], np.array(books["p"][j - 1])))
            back.append(quantise(b[at], np.array(books["b"][j - 1])) if j < order else np.zeros(0))
        first = key[0].as_py()
        name = os.path.join(path, f"shard-{first}")
        tmp = f"{name}.{os.getpid()}.{os.urandom(4).hex()}"
        with open(tmp, "wb") as f:
            f.write(Trie.build(codes, prob, back).to_bytes())
        os.replace(tmp, name)  # a retried task writes the same bytes
        return pa.table({"shard": pa.array([first], pa.int32()), "nodes": pa.array([t.num_rows], pa.int64())})

    of = F.expr(f"cast((shiftright(code, greatest(8 * (k - 2), 0)) * 40503) % 65536 * {shards} div 65536 as int)")
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    keyed = grams.where("k > 1").withColumn("shard", of).unionByName(grams.where("k = 1").withColumn("shard", F.explode(every)))
    keyed.groupBy("shard").applyInArrow(write, "shard int, nodes bigint").agg(F.sum("nodes")).collect()
    return folder


def _books(hist, order: int) -> list[list[float]]:
    """Per order at most 256 levels, each the mean of as many nodes as the others."""
    out = []
    for k in range(1, order + 1):
        v = sorted((r["v"], r["count"]) for r in hist if r["k"] == k)
        if not v:
            out.append([0.0])
            continue
        x, n = np.array([a for a, _ in v], float), np.array([b for _, b in v], float)
        if len(x) > BINS:
            bin_ = np.minimum((np.cumsum(n) - n / 2) * BINS / n.sum(), BINS - 1).astype(int)
            total, weight = np.bincount(bin_, n * x, BINS), np.bincount(bin_, n, BINS)
            x = total[weight > 0] / weight[weight > 0]
        out.append((x / 256).tolist())
    return out


def quantise(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The index of the nearest level."""
    i = np.clip(np.searchsorted(book, x), 1, max(len(book) - 1, 1))
    if len(book) == 1:
        return np.zeros(len(x), np.uint8)
    return (i - (x - book[i - 1] <= book[i] - x)).astype(np.uint8)


# ---------------------------------------------------------------- scoring
class Scorer:
    """Log probabilities from the mapped shards, with a fixed-size memo of grams in front."""

    SLOTS = 1 << 20

    def __init__(self, folder: str):
        self.path = _local(folder)
        with open(os.path.join(self.path, "books.json")) as f:
            spec = json.load(f)
        self.order, self.n_shards = spec["order"], spec["shards"]
        self.p = [np.array(b, np.float32) for b in spec["p"]]
        self.b = [np.array(b, np.float32) for b in spec["b"]]
        self.shards: dict[int, Trie | None] = {}
        self.keys = np.full(self.SLOTS, np.uint64(2**64 - 1))
        self.values = np.zeros(self.SLOTS, np.float32)

    def shard(self, first: int) -> Trie | None:
        if first not in self.shards:
            name = os.path.join(self.path, f"shard-{first}")
            self.shards[first] = Trie.from_buffer(np.memmap(name, np.uint8, "r")) if os.path.exists(name) else None
        return self.shards[first]

    def look_up(self, codes: np.ndarray) -> np.ndarray:
        """log p(last byte | the ones before) of N-grams, backing off from the longest order."""
        out = np.zeros(len(codes), np.float32)
        left = np.arange(len(codes))
        for k in range(self.order, 0, -1):
            part = codes[left] & np.uint64((1 << (8 * k)) - 1) if k < 8 else codes[left]
            first = _shard((part >> np.uint64(8 * max(k - 2, 0))).astype(np.int64), self.n_shards) if k > 1 else np.zeros(len(left), np.int64)
            found = np.zeros(len(left), bool)
            for s in np.unique(first):
                at = np.flatnonzero(first == s)
                trie = self.shard(int(s))
                if trie is None:
                    continue
                node, context = trie.walk(part[at], k)
                hit = node >= 0
                out[left[at[hit]]] += self.p[k - 1][trie.levels[k - 1][2][node[hit]]]
                found[at[hit]] = True
                if k > 1:
                    miss = ~hit & (context >= 0)
                    out[left[at[miss]]] += self.b[k - 2][trie.levels[k - 2][3][context[miss]]]
            left = left[~found]
        out[left] += self.rest()
        return out

    def rest(self) -> float:
        """A byte that was never seen: what the empty context leaves, evenly."""
        if not hasattr(self, "_rest"):
            t = self.shard(0)
            n, seen = (0, 0.0) if t is None else (len(t.levels[0][2]), float(np.exp(self.p[0][t.levels[0][2]].astype(np.float64)).sum()))
            self._rest = math.log(max((1 - seen) / max(256 - n, 1), 1e-12))
        return self._rest

    def score(self, codes: np.ndarray) -> np.ndarray:
        slot = (mix64(codes) & np.uint64(self.SLOTS - 1)).astype(np.int64)
        miss = self.keys[slot] != codes
        if miss.any():
            u, back = np.unique(codes[miss], return_inverse=True)
            value = self.look_up(u)
            out = self.values[slot]
            out[miss] = value[back]
            s = (mix64(u) & np.uint64(self.SLOTS - 1)).astype(np.int64)
            self.keys[s], self.values[s] = u, value
            # of several grams that share a slot the last stays, with its own value
            self.values[s] = np.where(self.keys[s] == u, value, self.values[s])
            return out
        return self.values[slot]


_scorers: dict[str, Scorer] = {}


def scorer(folder: str) -> Scorer:
    if folder not in _scorers:
        _scorers.clear()
        _scorers[folder] = Scorer(folder)
    return _scorers[folder]


def scored(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, number of bytes, log probability (nats) of the text and of its end, and bits per byte.

    A null text has null scores; an empty one has 0 bytes, the log probability of ending at once, and null bits per
    byte. Texts are read whole; repeated rows score alike and all stay; other columns are ignored; an empty table
    gives an empty result.
    """
    ship(docs.sparkSession)
    order = json.load(open(os.path.join(_local(folder), "books.json")))["order"]

    def run(text: pa.Array) -> pa.Array:
        model = scorer(folder)
        raw, off = utf8(text)
        n = np.diff(off)
        lp = np.zeros(len(n))
        for i, j in slices(off, 2000, 2 << 20):
            code, start = windows(raw[off[i] : off[j]], off[i : j + 1] - off[i], order)
            # windows that end in the text or in the first zero after it
            size = n[i:j] + 1
            first = start[:-1] + 1
            at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            s = model.score(code[at]).astype(np.float64)
            lp[i:j] = np.add.reduceat(s, np.concatenate([[0], np.cumsum(size)[:-1]]))
        null = np.asarray(text.is_null())
        bits = np.divide(-lp, n * math.log(2), out=np.zeros(len(n)), where=n > 0)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64(), mask=null), pa.array(lp, pa.float64(), mask=null), pa.array(bits, pa.float64(), mask=null | (n == 0))], ["n_bytes", "logprob", "bits_per_byte"])

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    f = F.arrow_udf(run, "struct<n_bytes:bigint,logprob:double,bits_per_byte:double>")
    return docs.select("doc_id", f(F.col("text")).alias("s")).select("doc_id", "s.n_bytes", "s.logprob", "s.bits_per_byte")
