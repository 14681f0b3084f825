"""Near duplicates by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

Features are hashed pairs of neighbouring words (case folded, punctuation dropped) weighted tf x ln(1 + N / df) over the N different
texts; df is counted exactly, by 32-bit shingle id: texts are turned into chunks of features, each chunk asks the ranges of ids for the df of its own, and the answers
go back to the chunk; nothing of it is gathered or broadcast. A signature is K ICWS samples (feature, level), each equal between two documents with the
probability of their weighted Jaccard similarity; bands of R samples give the candidate buckets. Every pair of a bucket is verified
by its exact weighted Jaccard, save those that verified pairs of the bucket join already; what is joined forms groups.
Equal texts are one node from the start, so copies cost nothing twice and change no weight.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checked_broadcast, ship, stored
from .common import mix64, packed, slices, unpacked, utf8
from .components import components

THRESHOLD = 0.6
BANDS, ROWS = 17, 4  # a pair at the threshold itself shares a band with a probability of 0.91
PARTS = 1024  # ranges of shingle ids that are counted apart, at least
PART_IDS = 4 << 20  # and so many ids to a range, up to 65536 ranges
CHUNK_BYTES = 4 << 20  # of text to a chunk of features
CHUNK = 4096  # a larger bucket is verified in pairs of chunks of so many texts

_U = np.uint64
_B = _U(0x9E3779B97F4A7C15)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = np.full(n, _B, _U)
    a[0] = 1
    b = np.full(n, _U(_inverse(int(_B))), _U)
    b[0] = 1
    return np.cumprod(a, dtype=_U), np.cumprod(b, dtype=_U)


_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of all texts, and the text it is in. From U+3000 on each character is a word."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    word = _WORD[raw]
    low = _FOLD[raw]
    if n > 1:
        capital = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        low[1:][capital] += 0x20
    starts_text = np.zeros(n + 1, bool)
    starts_text[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | starts_text[1:n] | (raw[1:] >= 0xE3)
    end = word.copy()
    end[:-1] &= ~word[1:] | starts_text[1:n] | (raw[1:] >= 0xE3)
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    size = 1 << 16
    while size < n + 1:
        size <<= 1
    power, inverse = _powers(size)
    total = np.zeros(n + 1, _U)
    np.cumsum((low.astype(_U) + _U(1)) * inverse[:n], dtype=_U, out=total[1:])
    h = (total[e + 1] - total[s]) * power[e]
    return mix64(h), np.searchsorted(offsets, s, "right") - 1


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, id, tf) of the distinct shingles of all texts, by text and id. The only word of a text is a shingle."""
    h, doc = word_hashes(raw, offsets)
    if not len(h):
        return doc, np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    pair = doc[1:] == doc[:-1]
    two = mix64(h[:-1] * _U(3) + h[1:])[pair]
    alone = np.ones(len(h), bool)
    alone[1:] &= ~pair
    alone[:-1] &= ~pair
    code = np.concatenate([(doc[1:][pair].astype(_U) << _U(32)) | (two >> _U(32)), (doc[alone].astype(_U) << _U(32)) | (h[alone] >> _U(32))])
    code.sort()
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    tf = np.diff(np.append(first, len(code)))
    code = code[first]
    return (code >> _U(32)).astype(np.int64), code.astype(np.uint32), tf.astype(np.uint32)


def chunks(texts: DataFrame) -> DataFrame:
    """node and text -> a row for about CHUNK_BYTES of text: chunk, n (texts), nodes, size (features of each text), n_ids, ids, tf."""

    def run(batches):
        held: list[tuple] = []

        def close():
            nodes, size, ids, tf = (x if k == 0 else np.concatenate(x) for k, x in enumerate(zip(*(h[1:] for h in held))))
            row = {"chunk": int.from_bytes(os.urandom(8), "big", signed=True), "n": len(size), "nodes": b"".join(nodes), "size": size.tobytes(), "n_ids": len(ids), "ids": ids.tobytes(), "tf": packed(tf)}
            held.clear()
            return pa.RecordBatch.from_pylist([row], _CHUNK)

        for b in batches:
            raw, off = utf8(b.column(1))
            for i, j in slices(off, 2000, 1 << 20):
                doc, ids, tf = features(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                held.append((off[j] - off[i], b"".join(b.column(0)[i:j].to_pylist()), np.bincount(doc, minlength=j - i).astype(np.uint32), ids, tf))
                if sum(h[0] for h in held) >= CHUNK_BYTES:
                    yield close()
        if held:
            yield close()

    return texts.mapInArrow(run, "chunk bigint, n bigint, nodes binary, size binary, n_ids bigint, ids binary, tf binary")


_CHUNK = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("nodes", pa.binary()), ("size", pa.binary()), ("n_ids", pa.int64()), ("ids", pa.binary()), ("tf", pa.binary())])


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order, and where each of the ids is among them."""
    order = np.argsort(ids)
    ordered = ids[order]
    first = np.ones(len(ids), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    at = np.empty(len(ids), np.int64)
    at[order] = np.cumsum(first) - 1
    return ordered[first], at


def _cuts(own: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts that have some of the rising ids, and where those of each begin and end."""
    at = np.searchsorted(own, np.arange(parts, dtype=np.uint64) * np.uint64((1 << 32) // parts))
    at = np.append(at, len(own))
    part = np.flatnonzero(np.diff(at))
    return part, np.append(at[part], len(own))


def parts_for(n_ids: int) -> int:
    parts = PARTS
    while parts < 1 << 16 and parts * PART_IDS < n_ids:
        parts *= 2
    return parts


def document_frequencies(chunked: DataFrame, parts: int) -> DataFrame:
    """chunk, part, df: over all texts, of the distinct ids of a chunk that are in a part of the ids, in their order; packed.

    Ids travel as their lower halves, with the number of ids for each upper half.
    """
    blocks = (1 << 16) // parts

    def ask(batches):
        for b in batches:
            for chunk, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own, at = _ranked(np.frombuffer(ids, np.uint32))
                count = np.bincount(at, minlength=len(own)).astype(np.uint32)
                part, cuts = _cuts(own, parts)
                upper = np.bincount(own >> np.uint32(16), minlength=1 << 16).astype(np.uint32).reshape(parts, blocks)
                lower = own.astype(np.uint16)
                sent = [upper[k].tobytes() + lower[a:e].tobytes() for k, a, e in zip(part, cuts[:-1], cuts[1:])]
                counts = [packed(count[a:e]) for a, e in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk)), pa.array(part.astype(np.int32)), pa.array(sent, pa.binary()), pa.array(counts, pa.binary())], ["chunk", "part", "ids", "count"])

    def local(data: np.ndarray) -> np.ndarray:
        upper = data[: 4 * blocks].view(np.uint32)
        return np.repeat(np.arange(blocks, dtype=np.int64) << 16, upper) + data[4 * blocks :].view(np.uint16)

    def count(t: pa.Table) -> pa.Table:
        raw, off = utf8(t.column("ids"))
        counts, ends = utf8(t.column("count"))
        df = np.zeros(blocks << 16, np.uint32)
        for a, b, c, d in zip(off[:-1], off[1:], ends[:-1], ends[1:]):
            ids = local(raw[a:b])
            df[ids] += unpacked(counts[c:d], len(ids))[0]  # the ids of a row differ
        answers = pa.array([packed(df[local(raw[a:b])]) for a, b in zip(off[:-1], off[1:])], pa.binary())
        return pa.table([t.column("chunk"), t.column("part"), answers], ["chunk", "part", "df"])

    asked = chunked.select("chunk", "ids").mapInArrow(ask, "chunk bigint, part int, ids binary, count binary")
    return asked.groupBy("part").applyInArrow(count, "chunk bigint, part int, df binary")


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p(n / df)


@lru_cache(1)
def _gamma() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) at 2^16 evenly spaced points, and their logs."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    lo, hi = np.zeros_like(u), np.full_like(u, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        less = 1 - np.exp(-mid) * (1 + mid) < u
        lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
    return lo.astype(np.float32), np.log(lo).astype(np.float32)


def signatures(doc_start: np.ndarray, ids: np.ndarray, log_w: np.ndarray, k: int) -> np.ndarray:
    """k ICWS samples of each text, as hashes of (feature, level). doc_start: where each (non-empty) text begins."""
    r_table, c_table = _gamma()
    out = np.empty((len(doc_start), k), np.uint32)
    base = ids.astype(_U) * _U(0xD6E8FEB86659FD93)
    mask = _U(0xFFFF)
    for j in range(k):
        h = base + _U(((j + 1) * 0xA0761D6478BD642F) % (1 << 64))
        h ^= h >> _U(32)
        h *= _U(0xE7037ED1A0B428DB)
        h ^= h >> _U(29)
        r = r_table[(h & mask).astype(np.intp)]
        beta = ((h >> _U(16)) & mask).astype(np.float32) * np.float32(1 / 65536)
        level = np.floor(log_w / r + beta)
        ln_a = c_table[((h >> _U(32)) & mask).astype(np.intp)] - r * (level - beta + np.float32(1))
        bits = ln_a.view(np.uint32)
        order = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(_U)  # order of the floats
        h ^= level.astype(np.int64).astype(_U) * _U(0x9FB21C651E98DF25)
        h *= _U(0xFF51AFD7ED558CCD)
        out[:, j] = np.minimum.reduceat((order << _U(32)) | (h >> _U(32)), doc_start).astype(np.uint32)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sig), bands), np.int64)
    for b in range(bands):
        h = np.full(len(sig), _U(b + 1))
        for r in range(rows):
            h = mix64(h * _U(31) + sig[:, b * rows + r].astype(_U))
        out[:, b] = h.view(np.int64)
    return out


def _node(text):
    return F.unhex(F.md5(text))


def signed(chunked: DataFrame, n: int, parts: int, bands: int, rows: int) -> DataFrame:
    """node (of equal texts), keys: the band keys, df: of its features in their order, packed; a row for each text of the chunks."""

    def sign(own: pa.Table, answers: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table([[], [], []], schema)
        r = own.to_pylist()[0]
        ids, size = (np.frombuffer(r[c], np.uint32) for c in ("ids", "size"))
        tf = unpacked(np.frombuffer(r["tf"], np.uint8), len(ids))[0]
        distinct, at = _ranked(ids)
        told = answers.sort_by("part")
        part, cuts = _cuts(distinct, parts)
        if told["part"].to_pylist() != part.tolist():
            raise RuntimeError("an answer is missing")
        known = [unpacked(np.frombuffer(x, np.uint8), k)[0] for x, k in zip(told["df"].to_pylist(), np.diff(cuts).tolist())]
        df = np.concatenate(known)[at] if known else ids
        off = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        w = np.log(tf * idf_of(df, n)).astype(np.float32)
        values = []
        for i, j in slices(off, 2000, 1 << 16):
            a, b = off[i], off[j]
            if a < b:
                values.append(band_keys(signatures(off[i:j][size[i:j] > 0] - a, ids[a:b], w[a:b], bands * rows), bands, rows).ravel())
        flat = np.concatenate(values) if values else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32)
        nodes = [r["nodes"][16 * i : 16 * i + 16] for i in range(len(size))]
        return pa.table([pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([packed(df[a:b]) for a, b in zip(off[:-1], off[1:])], pa.binary())], schema)

    schema = pa.schema([("node", pa.binary()), ("keys", pa.list_(pa.int64())), ("df", pa.binary())])
    answers = document_frequencies(chunked, parts)
    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(sign, "node binary, keys array<bigint>, df binary")


def _with_features(texts: DataFrame) -> DataFrame:
    def run(text: pa.Array) -> pa.Array:
        raw, off = utf8(text)
        out = []
        for i, j in slices(off, 2000, 1 << 20):
            doc, ids, tf = features(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            at = np.searchsorted(doc, np.arange(j - i + 1))
            out += [np.uint32(b - a).tobytes() + ids[a:b].tobytes() + packed(tf[a:b]) for a, b in zip(at[:-1], at[1:])]
        return pa.array(out, pa.binary())

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return texts.select("node", F.arrow_udf(run, "binary")(F.col("text")).alias("feat"))


def _opened(feat: bytes) -> Iterator[np.ndarray]:
    """ids, tf and df of a text's features."""
    data = np.frombuffer(feat, np.uint8)
    n = int(data[:4].view(np.uint32)[0])
    yield data[4 : 4 + 4 * n].view(np.uint32)
    tf, used = unpacked(data[4 + 4 * n :], n)
    yield tf
    yield unpacked(data[4 + 4 * n + used :], n)[0]


class Group:
    """The texts of a bucket as runs of features; n: the number of all texts."""

    def __init__(self, feats: list[bytes], n: int):
        self.ids, self.tf, df = zip(*(_opened(f) for f in feats))
        self.idf = [idf_of(d, n) for d in df]
        self.total = np.array([float((t * v).sum()) for t, v in zip(self.tf, self.idf)])

    def similar(self, a: int, others: np.ndarray, threshold: float) -> np.ndarray:
        """Which of the others have a weighted Jaccard similarity to a of at least the threshold."""
        # the smaller total over the larger bounds the similarity
        lo, hi = np.minimum(self.total[a], self.total[others]), np.maximum(self.total[a], self.total[others])
        ok = lo >= threshold * hi
        near = others[ok]
        if len(near):
            ids, tf, idf = (np.concatenate([x[o] for o in near]) for x in (self.ids, self.tf, self.idf))
            size = np.array([len(self.ids[o]) for o in near])
            mine = self.ids[a]
            at = np.minimum(np.searchsorted(mine, ids), len(mine) - 1)
            both = np.where(mine[at] == ids, np.minimum(self.tf[a][at], tf) * idf, 0.0)
            shared = np.add.reduceat(both, np.concatenate([[0], np.cumsum(size)[:-1]]))
            ok[ok] = shared >= threshold * (self.total[a] + self.total[near] - shared)
        return ok

    def links(self, threshold: float) -> list[tuple[int, int]]:
        """Edges that join exactly what all verified pairs of the bucket would join."""
        left, out = np.arange(len(self.ids)), []
        while len(left):
            seed, left = left[0], left[1:]
            todo = [seed]
            while todo and len(left):
                hit = self.similar(todo.pop(), left, threshold)
                new = left[hit]
                out += [(seed, x) for x in new]
                todo += list(new)
                left = left[~hit]
        return out


def verified_links(members: DataFrame, n: int, threshold: float) -> DataFrame:
    """(key, node, feat) sorted by key -> the verified links (u, v) within each key."""

    def run(batches):
        key, nodes, feats = None, [], []
        us, vs = [], []

        def close():
            if len(nodes) > 1:
                for a, b in Group(feats, n).links(threshold):
                    us.append(nodes[a])
                    vs.append(nodes[b])

        def drain():
            b = pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["u", "v"])
            us.clear()
            vs.clear()
            return b

        for b in batches:
            for k, node, f in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    close()
                    key, nodes, feats = k, [], []
                nodes.append(node)
                feats.append(f)
            if len(us) > 10_000:
                yield drain()
        close()
        yield drain()

    return members.mapInArrow(run, "u binary, v binary")


def different(named: DataFrame, rows: DataFrame) -> DataFrame:
    """node and text of one row of each node. rows: node, doc_id, copies of all."""
    many = rows.groupBy("node").agg(F.count("*").alias("ids"), F.min("doc_id").alias("__loom_rep"), F.sum("copies").alias("n"), F.min_by("copies", F.coalesce("doc_id", F.lit(2**63 - 1))).alias("again"))
    many = stored(many.where("n > 1").select("node", "__loom_rep", (F.col("again") > 1).alias("__loom_again")), "nd-copies")
    one = named.join(checked_broadcast(many, 56), "node", "left").where(F.col("__loom_again").isNull() | F.col("doc_id").eqNullSafe(F.col("__loom_rep")))
    once = one.where("not coalesce(__loom_again, false)").select("node", "text")
    if many.where("__loom_again").isEmpty():
        return once
    return once.unionByName(one.where("__loom_again").select("node", "text").dropDuplicates(["node"]))  # rows that repeat id and text


def groups(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, chunk: int = CHUNK) -> DataFrame:
    """node, doc_id, copies, group_size, rep_id, keep: a row for each text and doc_id of it, copies its rows; stored.

    keep marks the row with the least doc_id (nulls last) of its group, and of those the least node.
    """
    spark = docs.sparkSession
    ship(spark)
    named = docs.where("text is not null").select("doc_id", "text", _node(F.col("text")).alias("node"))
    rows_of = stored(named.groupBy("node", "doc_id").agg(F.count("*").alias("copies")), "nd-rows")
    texts = different(named, rows_of)
    chunked = stored(chunks(texts), "nd-chunks")
    n, n_ids = chunked.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_ids"), F.lit(0))).first()
    sig = stored(signed(chunked, n, parts_for(n_ids), bands, rows), "nd-sig")
    keys = sig.select("node", F.explode("keys").alias("key"))
    # buckets of the same texts, as most bands of near copies give them, are verified once
    h1, h2 = F.xxhash64("node"), F.xxhash64(F.lit(7), "node")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(h1).alias("f1"), F.bit_xor(h2).alias("f2")).where("n > 1")
    kept = stored(sizes.groupBy("n", "f1", "f2").agg(F.min("key").alias("key")).select("key", "n"), "nd-buckets")
    members = stored(keys.join(checked_broadcast(kept, 24), "key"), "nd-members")
    involved = stored(members.select("node").distinct(), "nd-nodes")
    some = checked_broadcast(involved, 40)
    feats = _with_features(texts.join(some, "node", "left_semi")).join(sig.select("node", "df").join(some, "node", "left_semi"), "node")
    feats = feats.select("node", F.concat("feat", "df").alias("feat"))
    # a bucket of c chunks becomes a key for each pair of chunks
    c = F.ceil(F.col("n") / chunk).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(3), "node"), c).cast("int")
    pairs = F.when(c == 1, F.array(F.col("key"))).otherwise(F.transform(F.sequence(F.lit(0), c - 1), lambda o: F.xxhash64("key", F.least(o, mine), F.greatest(o, mine))))
    work = members.select("node", F.explode(pairs).alias("key")).join(feats, "node").select("key", "node", "feat")
    links = verified_links(work.repartition("key").sortWithinPartitions("key", "node"), n, threshold)
    roots = components(links)
    grouped = stored(rows_of.join(checked_broadcast(stored(roots, "nd-roots"), 64), "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root"), "nd-grouped")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))
    found = grouped.groupBy("group").agg(F.sum("copies").alias("group_size"), least.alias("least"))
    out = grouped.join(found, "group")
    keep = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("node") == F.col("least.node"))
    return stored(out.select("node", "doc_id", "copies", "group_size", F.col("least.doc_id").alias("rep_id"), keep.alias("keep")), "nd-groups")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """doc_id, rep_id (the least doc_id of its group), group_size and keep (one row of a group has it) of every row.

    Groups are joined by pairs with a weighted Jaccard similarity of at least the threshold that share a band. Equal
    texts are always in one group, empty ones too; a text without words has no other partner. A row with a null text is a group of its own, with its doc_id
    as rep_id. Rows with null doc_ids take part, kept only if no other of the group has an id; of repeated rows one is kept. Texts
    are read whole; other columns are ignored; an empty table gives an empty result.
    """
    g = groups(docs, threshold, **how)
    # repeated rows again, in two steps so that no row makes a long array
    g = g.withColumn("step", F.explode(F.sequence(F.lit(0), F.expr("(copies - 1) div 4096"))))
    g = g.withColumn("i", F.explode(F.sequence(F.col("step") * 4096, F.least(F.col("copies"), (F.col("step") + 1) * 4096) - 1)))
    g = g.select("doc_id", "rep_id", "group_size", (F.col("keep") & (F.col("i") == 0)).alias("keep"))
    null = docs.where("text is null").select("doc_id", F.col("doc_id").alias("rep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("keep"))
    return g.unionByName(null)


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """The rows, with their columns as they were, that near_duplicates keeps: one of each group, and all without a text.

    Of rows that repeat both text and doc_id any one may be the one; their other columns may hold anything, maps too. Texts are compared
    whole; an empty table stays empty.
    """
    g = groups(docs, threshold, **how)
    out = stored(g.where("not keep or copies > 1").select(F.col("node").alias("__loom_node"), F.col("doc_id").alias("__loom_id"), F.col("keep").alias("__loom_keep")), "nd-out")
    out_b = checked_broadcast(out, 56)
    named = docs.withColumn("__loom_text", _node(F.col("text")))
    on = (F.col("__loom_text") == F.col("__loom_node")) & F.col("doc_id").eqNullSafe(F.col("__loom_id"))
    stay = named.join(out_b, on, "left_anti")
    if not out.where("__loom_keep").isEmpty():  # rows that repeat both id and text: one of them stays
        stay = stay.unionByName(named.join(out_b.where("__loom_keep"), on, "left_semi").dropDuplicates(["__loom_text", "doc_id"]))
    return stay.drop("__loom_text")
