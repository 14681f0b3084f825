"""Exact threshold links of embeddings by dual traversal of cover trees.

Vectors are compared on the unit sphere, where a cosine of at least t is a distance of at most sqrt(2 - 2t). Equal vectors
are one point, with the number of its copies. Points go to the nearest of some pivots (those of a large cell again, to pivots of its
own), and the points of a cell form a cover tree: the children
of a node of level i are centres that cover its points within 2^-(i+1), the node's own centre among them; levels at which a
node has one child only are left out. Each node keeps its covering radius, the distance to its farthest
descendant. Two trees are walked together from their roots: a pair of nodes is pruned if its centres lie farther apart than the two
covering radii and the threshold together, else their children are paired; pairs of leaves that are left are compared, in double
precision where single does not decide. A pair of nodes all of whose points must be within the threshold is counted as it is, without its pairs. The roots' own balls prune pairs
of trees before anything is sent. Each pair of trees gives the number of links of its points and a spanning forest of
them, never more rows than points.

No index prunes much where all points are about equally far apart; there the cost is that of all pairs of points. A pair of nodes that has hardly fewer
pairs of children than of points goes to matrix products at once, of some coordinates along the main directions of a sample and the length of the
rest: the product of these is never less than the cosine, and what it lets through is compared in full. Trees are files of the shared folder; none is sent. Where points cluster, or lie near a surface of few dimensions, most pairs of nodes go at the top.
"""

from __future__ import annotations

import io
import os
from functools import cached_property
from math import ceil, sqrt
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import BROADCAST_LIMIT, checked_broadcast, fresh_path, ship, stored
from .components import components

THRESHOLD = 0.95
CELL = 4096  # points to a tree, or 8 times the root of their number if that is more
SLACK = 2e-3  # covers the single-precision error of distances; what it lets through is verified
DEEPEST = 24  # levels; points closer than 2^-23 are all children of one node
BLOCK = 512
LOW = 24  # coordinates that are compared first, or the quarter of all if that is more
TILE = 256, 1024  # points of a matrix product
MOST_TASKS = 2000  # that pairs of trees are divided among


def unit(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    return (y / np.sqrt((y * y).sum(1))[:, None]).astype(np.float32)


def lowered(x: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    """Of unit vectors the coordinates in an orthonormal basis and the length of the rest; without a basis all coordinates."""
    y = x.astype(np.float64)
    y /= np.sqrt((y * y).sum(1))[:, None]
    if basis is None:
        return y.astype(np.float32)
    z = y @ basis.T
    return np.column_stack([z, np.sqrt(np.maximum(0, 1 - (z * z).sum(1)))]).astype(np.float32)


def _basis(sample: np.ndarray) -> np.ndarray | None:
    """The main directions of some vectors; None where there are few coordinates."""
    dim = sample.shape[1]
    if dim <= LOW:
        return None
    y = sample.astype(np.float64)
    return np.linalg.svd(y / np.sqrt((y * y).sum(1))[:, None], full_matrices=False)[2][: max(LOW, dim // 4) - 1]


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances of unit vectors."""
    d = a @ b.T
    np.multiply(d, -2, out=d)
    d += 2
    np.maximum(d, 0, out=d)
    return np.sqrt(d, out=d)


class CoverTree:
    """Nodes by number, the root 0, with their centre (a point), covering radius, and first child and number of children."""

    NAMES = ("points", "centre", "radius", "first", "count", "rep", "copies", "key", "low", "order", "lo", "hi")

    def __init__(self, points, centre, radius, first, count, rep, copies, key, low=None, order=None, lo=None, hi=None):
        self.points, self.centre, self.radius, self.first, self.count = points, centre, radius, first, count
        self.rep, self.copies, self.key = rep, copies, key  # of each point its least id, its number of rows and 16 bytes that name it
        self.low = low  # of the points in the order of the leaves: see lowered
        if order is not None:
            self._leaves = self.order, self.lo, self.hi = order, lo, hi

    @cached_property
    def at(self) -> np.ndarray:
        return unit(self.points) if len(self.points) else self.points

    @cached_property
    def ordered(self) -> np.ndarray:
        """The unit vectors in the order of the leaves."""
        return self.at[self.leaves()[0]]

    @classmethod
    def build(cls, points: np.ndarray, rep: np.ndarray, copies: np.ndarray, key: np.ndarray, basis: np.ndarray | None = None) -> CoverTree:
        x = unit(points)
        centre, radius, first, count = [0], [0.0], [0], [0]
        todo = [(0, np.arange(len(x)), 0)]
        while todo:
            node, members, level = todo.pop()
            d = _far(x[members], x[centre[node]][None])[:, 0]
            d[members == centre[node]] = 0
            radius[node] = float(d.max())
            if len(members) == 1:
                continue
            while level < DEEPEST and d.max() <= 2.0**-level:  # one child only
                level += 1
            if level >= DEEPEST:
                parts = [members[i : i + 1] for i in range(len(members))]
                heads = list(members)
            else:
                heads, parts = _cover(x, members[np.argsort(d, kind="stable")], 2.0**-level)
            first[node], count[node] = len(centre), len(heads)
            for h, p in zip(heads, parts):
                if len(p) > 1:
                    todo.append((len(centre), p, level + 1))
                centre.append(int(h))
                radius.append(0.0)
                first.append(0)
                count.append(0)
        t = cls(points, np.array(centre), np.array(radius, np.float32), np.array(first), np.array(count), rep, copies, key)
        t.low = lowered(points[t.leaves()[0]], basis)
        return t

    def leaves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The points in the order of the leaves, and of each node the range of its own there."""
        if not hasattr(self, "_leaves"):
            order, lo, hi = np.empty(len(self.points), np.int64), np.zeros(len(self.centre), np.int64), np.zeros(len(self.centre), np.int64)
            n, todo = 0, [(0, False)]
            first, count, centre = self.first.tolist(), self.count.tolist(), self.centre.tolist()
            while todo:
                node, seen = todo.pop()
                if seen:
                    hi[node] = n
                elif not count[node]:
                    lo[node], order[n] = n, centre[node]
                    n += 1
                    hi[node] = n
                else:
                    lo[node] = n
                    todo.append((node, True))
                    todo += [(c, False) for c in range(first[node], first[node] + count[node])]
            self._leaves = self.order, self.lo, self.hi = order, lo, hi
        return self._leaves

    def to_bytes(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, **{n: getattr(self, n) for n in self.NAMES})
        return f.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> CoverTree:
        return cls.read(io.BytesIO(data))

    @classmethod
    def read(cls, file) -> CoverTree:
        with np.load(file) as z:
            return cls(*(z[n] for n in cls.NAMES))


def _cover(x: np.ndarray, members: np.ndarray, radius: float) -> tuple[list[int], list[np.ndarray]]:
    """Centres among the members, the first one included, more than radius apart, and the members nearest to each."""
    heads: list[int] = []
    parts: dict[int, list[np.ndarray]] = {}
    left = members
    while len(left):
        block = left[:256]
        d = _far(x[block], x[block])
        covered = np.zeros(len(block), bool)
        chosen = []
        for i in range(len(block)):
            if not covered[i]:
                chosen.append(i)
                covered |= d[i] <= radius
        new = block[chosen]
        d = _far(x[left], x[new])
        d[chosen] = 9  # a centre is its own; the block leads what is left
        d[chosen, np.arange(len(new))] = 0
        near = d.argmin(1)
        inside = d[np.arange(len(left)), near] <= radius
        inside[: len(block)] = True
        got, near = left[inside], near[inside]
        order = np.argsort(near, kind="stable")
        cut = np.searchsorted(near[order], np.arange(len(new) + 1))
        for k, c in enumerate(new):
            heads.append(int(c))
            parts[int(c)] = got[order[cut[k] : cut[k + 1]]]
        left = left[~inside]
    return heads, [parts[h] for h in heads]


def _similar(a: CoverTree, b: CoverTree, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    sim = np.empty(len(p))
    for t in range(0, len(p), 1 << 16):
        x, y = a.points[p[t : t + (1 << 16)]].astype(np.float64), b.points[q[t : t + (1 << 16)]].astype(np.float64)
        sim[t : t + (1 << 16)] = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
    return np.minimum(sim, 1.0)


def _tiles(a: CoverTree, b: CoverTree, rows: tuple[int, int], columns: tuple[int, int], threshold: float, own: bool):
    """Points of a, points of b and their similarity (in single precision, unless that leaves it open whether they are linked) of the pairs of leaves in two ranges.

    own: the ranges are those of one node, of which each pair counts once.
    """
    guard = 1e-5 + 1.2e-7 * a.points.shape[1]  # more than single precision can err
    least = np.float32(threshold - guard)
    at_a, at_b = a.leaves()[0], b.leaves()[0]
    room = np.empty(TILE, np.float32), np.empty(TILE, bool)
    for s in range(*rows, TILE[0]):
        e = min(s + TILE[0], rows[1])
        for u in range(*columns, TILE[1]):
            w = min(u + TILE[1], columns[1])
            if own and w <= s + 1:
                continue
            whole = (e - s, w - u) == TILE
            most = np.matmul(a.low[s:e], b.low[u:w].T, out=room[0] if whole else None)
            hit = np.greater_equal(most, least, out=room[1] if whole else None)
            n = np.count_nonzero(hit)
            if not n:
                continue
            if 16 * n > hit.size:
                dot = a.ordered[s:e] @ b.ordered[u:w].T
                at = np.flatnonzero(dot >= least)
                dot = dot.ravel()[at]
            else:
                at = np.flatnonzero(hit)
                dot = np.einsum("ij,ij->i", a.ordered[s + at // (w - u)], b.ordered[u + at % (w - u)])
            p, q = s + at // (w - u), u + at % (w - u)
            near = dot >= least
            if own:
                near &= p < q
            p, q, dot = at_a[p[near]], at_b[q[near]], dot[near].astype(np.float64)
            open_ = np.flatnonzero(dot < threshold + guard)
            if len(open_):
                dot[open_] = _similar(a, b, p[open_], q[open_])
                near = np.ones(len(p), bool)
                near[open_] = dot[open_] >= threshold
                p, q, dot = p[near], q[near], dot[near]
            if len(p):
                yield p, q, dot


def close_points(a: CoverTree, b: CoverTree, threshold: float, whole: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points of a, points of b and their similarity, of all pairs of at least the threshold; of a tree with itself each pair once.

    Given a list whole, pairs of nodes all of whose points are as near go there instead, as two arrays of nodes; of a node with
    itself all pairs of its points are meant.
    """
    found = [(p, q) for p, q, _ in _close(a, b, threshold, whole)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    p, q = (np.concatenate(x) for x in zip(*found))
    return p, q, _similar(a, b, p, q)


def _close(a: CoverTree, b: CoverTree, threshold: float, whole: list | None):
    """As close_points, in batches, with similarities that may be of single precision."""
    same = a is b
    eps = sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    sure = np.float32(eps - 2 * SLACK if whole is not None else -1)
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    (_, lo_a, hi_a), (_, lo_b, hi_b) = a.leaves(), b.leaves()
    if same and not a.count[0]:
        return
    if not same and _far(unit(a.points[a.centre[:1]]), unit(b.points[b.centre[:1]]))[0, 0] > a.radius[0] + b.radius[0] + eps:
        return
    while len(i):
        # a leaf stands for its own child
        fi, ci = np.where(a.count[i] > 0, a.first[i], i), np.maximum(a.count[i], 1)
        fj, cj = np.where(b.count[j] > 0, b.first[j], j), np.maximum(b.count[j], 1)
        # the times, in nanoseconds, that the pairs of children and those of all points take
        every = 15_000 + 2.0 * (hi_a[i] - lo_a[i]) * (hi_b[j] - lo_b[j])
        at_once = every <= ci * cj * np.where(ci * cj > BLOCK, 6, 100)
        for x, y in zip(i[at_once].tolist(), j[at_once].tolist()):
            yield from _tiles(a, b, (int(lo_a[x]), int(hi_a[x])), (int(lo_b[y]), int(hi_b[y])), threshold, same and x == y)
        i, j, fi, ci, fj, cj = (x[~at_once] for x in (i, j, fi, ci, fj, cj))
        big = ci * cj > BLOCK
        next_i, next_j, found = [], [], []

        def keep(u, v, far):
            inside = far + a.radius[u] + b.radius[v] <= sure
            if inside.any():
                whole.append((u[inside], v[inside]))
                u, v = u[~inside], v[~inside]
            leaf = (a.count[u] == 0) & (b.count[v] == 0)
            if leaf.any():
                found.append((a.centre[u[leaf]], b.centre[v[leaf]]))
            next_i.append(u[~leaf])
            next_j.append(v[~leaf])

        for k in np.flatnonzero(big):
            u, v = np.arange(fi[k], fi[k] + ci[k]), np.arange(fj[k], fj[k] + cj[k])
            xv, rv = b.at[b.centre[v]], b.radius[v] + np.float32(eps)
            for s in range(0, len(u), BLOCK):
                w = u[s : s + BLOCK]
                far = _far(a.at[a.centre[w]], xv)
                p, q = np.nonzero(far <= a.radius[w][:, None] + rv[None])
                far, p, q = far[p, q], w[p], v[q]
                if same and i[k] == j[k]:
                    ok = (p < q) | ((p == q) & (a.count[p] > 0))
                    far, p, q = np.where(p == q, 0, far)[ok], p[ok], q[ok]
                keep(p, q, far)
        small = np.flatnonzero(~big)
        for s in range(0, len(small), 4096):
            k = small[s : s + 4096]
            n = ci[k] * cj[k]
            row = np.repeat(np.arange(len(k)), n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            u = fi[k][row] + within // cj[k][row]
            v = fj[k][row] + within % cj[k][row]
            if same:
                own = i[k][row] == j[k][row]
                ok = ~own | (u < v) | ((u == v) & (a.count[u] > 0))
                u, v = u[ok], v[ok]
            for t in range(0, len(u), 1 << 16):
                p, q = u[t : t + (1 << 16)], v[t : t + (1 << 16)]
                dot = np.einsum("ij,ij->i", a.at[a.centre[p]], b.at[b.centre[q]])
                far = np.sqrt(np.maximum(2 - 2 * dot, 0))
                if same:
                    far[p == q] = 0
                near = far <= a.radius[p] + b.radius[q] + np.float32(eps)
                keep(p[near], q[near], far[near])
        i = np.concatenate(next_i) if next_i else np.zeros(0, np.int64)
        j = np.concatenate(next_j) if next_j else np.zeros(0, np.int64)
        if found:
            p, q = (np.concatenate(x) for x in zip(*found))
            sim = _similar(a, b, p, q)
            ok = sim >= threshold
            yield p[ok], q[ok], sim[ok]


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least number of the component of each of n points that the edges join."""
    root = np.arange(n)
    while True:
        new = root.copy()
        low = np.minimum(root[u], root[v])
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            return root
        root = new


def links(a: CoverTree, b: CoverTree, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the points of a, and then those of b if that is another tree: rows linked to each, and the least point of its component here."""
    same, whole = a is b, []
    base = 0 if same else len(a.points)
    count = np.zeros(base + len(b.points), np.int64)
    root, edges, held = np.arange(len(count)), [], 0
    for p, q, _ in _close(a, b, threshold, whole):
        np.add.at(count, p, b.copies[q])
        np.add.at(count, q + base, a.copies[p])
        x, y = root[p], root[q + base]
        edges.append((x[x != y], y[x != y]))
        held += len(edges[-1][0])
        if held > 1 << 19:  # what is joined already is one point from then on
            root = _roots(len(count), *(np.concatenate(x) for x in zip(*edges)))[root]
            edges, held = [], 0
    edges.append((np.arange(len(count)), root))
    u, v = (np.concatenate(x) for x in zip(*whole)) if whole else (np.zeros(0, np.int64),) * 2

    def spread(t, node, rows):
        """Of the leaves of a tree, in their order, the sum of rows over the nodes that each is in."""
        _, lo, hi = t.leaves()
        out = np.zeros(len(t.points) + 1, np.int64)
        np.add.at(out, lo[node], rows)
        np.add.at(out, hi[node], -rows)
        return np.cumsum(out)[:-1]

    def rows(t, node):
        order, lo, hi = t.leaves()
        total = np.concatenate([[0], np.cumsum(t.copies[order])])
        return total[hi[node]] - total[lo[node]]

    other = u != v if same else np.ones(len(u), bool)
    count[a.leaves()[0]] += spread(a, u, rows(b, v))
    count[b.leaves()[0] + base] += spread(b, v[other], rows(a, u)[other])
    if same:  # a node with itself counts each of its points' own rows
        count[a.leaves()[0]] -= spread(a, u[~other], np.ones((~other).sum(), np.int64)) * a.copies[a.leaves()[0]]
    # what lies in a node that is near as a whole is joined to one of it; a node within another adds nothing
    for t, nodes, at in (((a, np.concatenate([u, v]), 0),) if same else ((a, u, 0), (b, v, base))):
        order, lo, hi = t.leaves()
        end = np.zeros(len(order) + 1, np.int64)
        np.maximum.at(end, lo[nodes], hi[nodes])
        before = np.concatenate([[0], np.maximum.accumulate(end)[:-1]])
        for s in np.flatnonzero(end > before).tolist():
            edges.append((np.full(end[s] - s, order[s] + at), order[s : end[s]] + at))
    edges.append((a.leaves()[0][a.leaves()[1][u]], b.leaves()[0][b.leaves()[1][v]] + base))
    return count, _roots(len(count), *(np.concatenate(x) for x in zip(*edges)))


def _flat(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def _points(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vec_id and key (null without a usable vector), once each; and key, v, rep, copies, dim, h of each vector. Both stored."""
    e = embeddings.where("vec_id is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("raw"))
    fine = (F.size("raw") > 0) & F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))) & F.exists("raw", lambda x: x != 0)
    most = F.array_max(F.transform("raw", lambda x: F.abs(x.cast("double"))))
    # vectors near the ends of single precision are scaled by a power of two, which is exact
    scale = F.pow(F.lit(2.0), F.floor(F.log2(most)))
    usual = (most >= F.lit(1e-18)) & (most <= F.lit(1e18))
    v = F.when(usual, F.col("raw").cast("array<float>")).otherwise(F.transform("raw", lambda x: (x.cast("double") / scale).cast("float")))
    e = e.withColumn("v", F.when(F.coalesce(fine, F.lit(False)), v))
    h = F.xxhash64("v")
    key = F.unhex(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in (h, F.xxhash64(F.lit(7), F.col("v"))))))
    e = e.select("vec_id", "v", F.when(F.col("v").isNotNull(), key).alias("key"))
    members = stored(e.select("vec_id", "key").distinct(), "cj-members")
    n = members.where("key is not null").groupBy("key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("rep"))
    points = e.where("key is not null").select("key", "v").groupBy("key").agg(F.first("v").alias("v")).join(n, "key")
    return members, stored(points.select("key", "v", "rep", "copies", F.size("v").alias("dim"), h.alias("h")), "cj-points")


def _nearest(points: DataFrame, pivots: dict[tuple, np.ndarray], by: list[str]) -> Column:
    """The number of the nearest of the pivots that a row's columns name; 0 where there are none."""
    shared = points.sparkSession.sparkContext.broadcast({k: unit(p) for k, p in pivots.items()})

    def run(key: pa.Array, v: pa.Array) -> pa.Array:
        out, rows = np.zeros(len(v), np.int32), {}
        for i, k in enumerate(key.to_pylist()):
            rows.setdefault(tuple(k), []).append(i)
        for k, at in rows.items():
            if k in shared.value:
                x = unit(_flat(v.take(pa.array(at)), k[0]))
                for s in range(0, len(x), 4096):
                    out[at[s : s + 4096]] = (x[s : s + 4096] @ shared.value[k].T).argmax(1)
        return pa.array(out)

    run.__annotations__ = {"key": pa.Array, "v": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "int")(F.array(*by), F.col("v"))


def _placed(points: DataFrame, cell: int) -> tuple[DataFrame, dict[int, np.ndarray | None]]:
    """The points with the dim, cell, sub and part of the tree that each is in, stored; and for each dim the basis of what is compared first.

    Pivots are the points with the lowest hashes: about the eighth of the root of their number, and for a cell of over 4 x cell points one for
    every cell of them, though not more in all than a broadcast holds. What is larger still is cut by hash.
    """
    pivots: dict[tuple, np.ndarray] = {}
    bases: dict[int, np.ndarray | None] = {}
    for r in points.groupBy("dim").count().collect():
        size = max(cell, ceil(8 * sqrt(r["count"])))
        n = ceil(r["count"] / size)
        sample = 4 * max(LOW, r["dim"] // 4) if r["dim"] > LOW else 0
        top = points.where(F.col("dim") == r["dim"]).orderBy("h", "key").limit(max(n, sample)).select("v").collect()
        top = np.array([x["v"] for x in top], np.float32)
        pivots[(r["dim"],)], bases[r["dim"]] = top[:n], _basis(top)
    placed = stored(points.withColumn("cell", _nearest(points, pivots, ["dim"])), "cj-cells")
    sizes = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > 4 * cell).collect()  # at most a row for each pivot
    if large:
        room = max(1, BROADCAST_LIMIT // (8 * sum(r["dim"] * ceil(r["n"] / cell) for r in large) or 1))
        few = spark_rows(points, [(r["dim"], r["cell"], (min(1.0, room) / cell)) for r in large])
        unit_h = (F.xxhash64("h").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).alias("x")
        found = placed.join(F.broadcast(few), ["dim", "cell"]).where(unit_h < F.col("share")).select("dim", "cell", "v", "key").collect()
        below: dict[tuple, list] = {}
        for r in sorted(found, key=lambda r: bytes(r["key"])):
            below.setdefault((r["dim"], r["cell"]), []).append(r["v"])
        placed = stored(placed.withColumn("sub", _nearest(points, {k: np.array(x, np.float32) for k, x in below.items()}, ["dim", "cell"])), "cj-subs")
    else:
        placed = placed.withColumn("sub", F.lit(0))
    many = stored(placed.groupBy("dim", "cell", "sub").agg(F.ceil(F.count("*") / (4 * cell)).cast("int").alias("parts")).where("parts > 1"), "cj-parts")
    placed = placed.join(checked_broadcast(many, 64), ["dim", "cell", "sub"], "left")
    return placed.withColumn("part", F.pmod(F.xxhash64("h"), F.coalesce("parts", F.lit(1))).cast("int")), bases


def spark_rows(like: DataFrame, rows: list[tuple]) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, "dim int, cell int, share double")


def _walked(points: DataFrame, threshold: float, cell: int, result, schema: str) -> DataFrame:
    """The batches of result(tree, tree) over all pairs of trees, and each with itself, that can hold a link."""
    placed, bases = _placed(points, cell)
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast(bases)
    folder = urlparse(fresh_path(spark, "cj-files"))
    if folder.scheme not in ("", "file"):
        raise RuntimeError("trees are files that tasks read: spark.checkpoint.dir must be a mounted folder (file://)")
    folder = folder.path
    os.makedirs(folder, exist_ok=True)

    def file_of(tree: tuple) -> str:
        return os.path.join(folder, "-".join(map(str, tree)))

    def grow(key, t):
        t = t.combine_chunks().sort_by([("h", "ascending"), ("key", "ascending")])
        key = tuple(k.as_py() for k in key)
        names = np.frombuffer(b"".join(t["key"].to_pylist()), np.uint8).reshape(-1, 16)
        tree = CoverTree.build(_flat(t["v"], key[0]), t["rep"].to_numpy(), t["copies"].to_numpy(), names, shared.value[key[0]])
        root = tree.at[tree.centre[0]]
        name = file_of(key)
        tmp = f"{name}.{os.getpid()}.{os.urandom(4).hex()}"
        with open(tmp, "wb") as f:
            f.write(tree.to_bytes())
        os.replace(tmp, name)  # a retried task writes the same bytes
        return pa.table({**{c: pa.array([k], pa.int32()) for c, k in zip(("dim", "cell", "sub", "part"), key)}, "root": pa.array([root.tolist()], pa.list_(pa.float32())), "radius": pa.array([float(tree.radius[0])], pa.float32())})

    by = ("dim", "cell", "sub", "part")
    trees = placed.select(*by, "v", "rep", "copies", "key", "h").groupBy(*by).applyInArrow(grow, "dim int, cell int, sub int, part int, root array<float>, radius float")
    heads = stored(trees.withColumn("id", F.struct(*by)).select("id", "root", "radius"), "cj-trees")
    # which pairs of trees can hold a link: their balls, widened by the threshold, meet
    a, b = heads.select(*(F.col(c).alias(f"a_{c}") for c in heads.columns)), heads.select(*(F.col(c).alias(f"b_{c}") for c in heads.columns))
    dot = F.aggregate(F.zip_with("a_root", "b_root", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    reach = F.col("a_radius") + F.col("b_radius") + F.lit(sqrt(max(0.0, 2 - 2 * threshold)) + SLACK)
    meet = a.join(b, (F.col("a_id.dim") == F.col("b_id.dim")) & (F.col("a_id") <= F.col("b_id")))
    meet = meet.where((F.col("a_id") == F.col("b_id")) | (F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot)) <= reach))
    # a task takes some of the pairs of one tree. Which of the two is that alternates, so no tree has all the work
    swap = F.pmod(F.xxhash64("a_id", "b_id"), F.lit(2)) == 0
    jobs = stored(meet.select(F.when(swap, F.col("b_id")).otherwise(F.col("a_id")).alias("own"), F.when(swap, F.col("a_id")).otherwise(F.col("b_id")).alias("id")), "cj-jobs")
    n = jobs.count()
    tasks = min(MOST_TASKS, max(n // 16, min(n, 4 * spark.sparkContext.defaultParallelism), 1))

    def walk(batches):
        own, held = None, None
        for batch in batches:
            for key, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key, other = tuple(key.values()), tuple(other.values())
                if key != own:
                    own, held = key, CoverTree.read(file_of(key))
                yield from result(held, held if other == own else CoverTree.read(file_of(other)))

    salt = F.pmod(F.xxhash64("id"), F.lit(max(1, 2 * tasks // max(1, heads.count()))))
    return jobs.repartition(tasks, "own", salt).sortWithinPartitions("own", "id").mapInArrow(walk, schema)


def linked(embeddings: DataFrame, threshold: float = THRESHOLD, cell: int = CELL) -> DataFrame:
    """vec_id, class_id, n_links: a row for each id and vector of it.

    n_links is the number of other such rows with a cosine of at least the threshold (0 < threshold <= 1), equal vectors included; class_id is the
    least vec_id among all rows that links, and links of theirs, join to the row. Copies are counted, not paired. Rows without an id are left
    out; embeddings that are null, empty, of length 0 or hold a null, NaN or infinity have no links and are classes of their own, and so
    are, to each other, embeddings of different dimensions. A row that is repeated counts once; one id with several vectors has a row for each of them. Other
    columns are ignored; an empty table gives an empty result. Values are taken in single precision, after scaling if they are near its ends.
    """
    ship(embeddings.sparkSession)
    members, points = _points(embeddings)

    def found(a: CoverTree, b: CoverTree):
        n, root = links(a, b, threshold)
        key = a.key if a is b else np.concatenate([a.key, b.key])
        at = np.flatnonzero(n)
        names = lambda k: pa.Array.from_buffers(pa.binary(16), len(k), [None, pa.py_buffer(np.ascontiguousarray(key[k]))]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([names(at), pa.array(n[at]), names(root[at])], ["key", "n", "root"])

    seen = stored(_walked(points, threshold, cell, found, "key binary, n bigint, root binary"), "cj-links")
    n = seen.groupBy("key").agg(F.sum("n").alias("n"))
    roots = components(seen.select(F.col("key").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "key")
    point = stored(points.select("key", "rep", "copies").join(roots, "key", "left").join(n, "key", "left").withColumn("root", F.coalesce("root", "key")), "cj-roots")
    least = point.groupBy("root").agg(F.min("rep").alias("class_id"))
    point = stored(point.join(least, "root").select("key", "class_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "cj-result")
    out = members.join(checked_broadcast(point, 48), "key", "left")
    return out.select("vec_id", F.coalesce("class_id", "vec_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def pairs(embeddings: DataFrame, threshold: float = THRESHOLD, cell: int = CELL) -> DataFrame:
    """vec_a < vec_b and similarity (to 6 digits) of the pairs of different vectors with a cosine of at least the threshold.

    A vector goes by the least of its ids. What counts, and what does not, is as for linked; the result grows with the square of what lies close together.
    """
    ship(embeddings.sparkSession)

    def found(a: CoverTree, b: CoverTree):
        p, q, sim = close_points(a, b, threshold)
        x, y = a.rep[p], b.rep[q]
        ok = x != y
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[ok], pa.int64()), pa.array(np.maximum(x, y)[ok], pa.int64()), pa.array(sim[ok], pa.float64())], ["vec_a", "vec_b", "similarity"])

    out = _walked(_points(embeddings)[1], threshold, cell, found, "vec_a bigint, vec_b bigint, similarity double")
    return out.select("vec_a", "vec_b", F.round("similarity", 6).alias("similarity"))
