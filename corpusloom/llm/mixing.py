"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule has the point frac(i / golden ratio), in integers; the source whose share of the cumulative
weights holds the point gets the slot, so every stretch of the schedule has each source in its weight to within a few slots. The rank of a
slot among those of its source is the block it takes. The blocks of a source are its documents in keyed pseudo-random
order, cut every block_tokens tokens; a source that is asked for more starts anew (an epoch). Blocks that no slot asks for come after the schedule. Ranks and token offsets are prefix sums in two levels
(per chunk, then within), so neither a hot source nor a long schedule is one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import BROADCAST_LIMIT, ship, stored

BLOCK_TOKENS = 4096
TEMPERATURE = 0.7  # weights without a target: the power of each source's share of the tokens
REPEAT = 4  # the schedule has at most so many times the blocks there are; see plan
SEED = "mix-1"
DOCS_PER_BUCKET = 2_048  # documents that one task orders at a time
CELL_DIGITS = 5  # hexadecimal digits of a document's hash that tell its cell; buckets are runs of cells
POINT_BITS = 31
STEP = 1327217885  # 2^31 over the golden ratio, odd
CHUNK_BITS = 16
TOKEN = r"[^ \t\n\r]+"
SPACED = r"[ \t\n\r]*[^ \t\n\r]+([ \t\n\r]+\z)?"


def _floor_sum(n: int, m: int, a: int, b: int) -> int:
    """The sum of (a i + b) // m over 0 <= i < n."""
    out = 0
    while n > 0:
        q, a = divmod(a, m)
        r, b = divmod(b, m)
        out += q * (n * (n - 1) // 2) + r * n
        top = a * n + b
        n, b = divmod(top, m)
        m, a = a, m
        if not m:
            break
    return out


def _held(slots: int, upto: int) -> int:
    """How many of the first slots have a point below upto (at most 2^POINT_BITS)."""
    m = 1 << POINT_BITS
    return _floor_sum(slots, m, STEP, 0) - _floor_sum(slots, m, STEP, m - upto) + slots


def plan(totals: dict, weights: dict | None = None, block_tokens: int = BLOCK_TOKENS, slots: int | None = None, repeat: int = REPEAT):
    """(sources in order, blocks of each, first point of each, slots of the schedule, blocks of each that it reaches).

    Sources without tokens or weight get no slot; any other has one point at least, however small its share. Without a number of slots there
    are as many as give every source its tokens once at its weight, but at most repeat times the blocks there are.
    Blocks that the schedule doesn't reach (some at its end, those of a source with many tokens and little weight) follow it, once each.
    """
    names = sorted((s for s, n in totals.items() if n and (weights is None or weights.get(s, 0) > 0)), key=lambda s: (s is None, s or ""))
    if not names:
        return [], [], [], 0, []
    raw = [totals[s] ** TEMPERATURE if weights is None else float(weights[s]) for s in names]
    blocks = [-(-totals[s] // block_tokens) for s in names]
    total, points, edge, top = math.fsum(raw), [], 0.0, 1 << POINT_BITS
    for i, w in enumerate(raw):
        least = points[-1] + 1 if points else 0
        points.append(min(max(round(edge / total * top), least), top - len(names) + i))
        edge += w
    edges = [*points, top]
    if slots is None:
        need = max(-(-totals[s] * top // (block_tokens * (edges[i + 1] - edges[i]))) for i, s in enumerate(names))
        slots = min(need, repeat * sum(blocks))
    reached = [min(b, _held(slots, edges[i + 1]) - _held(slots, edges[i])) for i, b in enumerate(blocks)]
    return names, blocks, points, slots, reached


def _place(x: Column, values: list[int]) -> Column:
    """The place of the last of the rising values that is at most x."""
    if len(values) <= 64:
        return F.size(F.filter(F.array(*[F.lit(v) for v in values]), lambda v: v <= x)) - 1
    edges = np.array(values, np.int64)

    def run(x: pa.Array) -> pa.Array:
        return pa.array((np.searchsorted(edges, x.to_numpy(zero_copy_only=False), "right") - 1).astype(np.int32))

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "int")(x)


def schedule(spark, points: list[int], slots: int, blocks: list[int] | None = None, reached: list[int] | None = None) -> DataFrame:
    """slot, src (place among the sources), rank (0-based among the slots of src); after them, source by source, the blocks not reached."""
    i = F.col("id")
    point = F.pmod(F.pmod(i, F.lit(1 << POINT_BITS)) * F.lit(STEP), F.lit(1 << POINT_BITS))
    s = spark.range(slots).select(i.alias("slot"), _place(point, points).alias("src"), F.shiftright(i, CHUNK_BITS).alias("chunk"))
    sums = s.groupBy("chunk", "src").count()
    before = F.sum("count").over(Window.partitionBy("src").orderBy("chunk")) - F.col("count")
    inner = s.withColumn("r", F.row_number().over(Window.partitionBy("chunk", "src").orderBy("slot")) - 1)
    out = inner.join(sums.select("chunk", "src", before.alias("base")), ["chunk", "src"]).select("slot", "src", (F.col("base") + F.col("r")).alias("rank"))
    late = [(k, b - r, r) for k, (b, r) in enumerate(zip(blocks or [], reached or [])) if b > r]
    if late:
        ends = np.cumsum([n for _, n, _ in late]).tolist()
        starts = [0, *ends[:-1]]
        of = spark.createDataFrame([(j, k, r - at) for j, ((k, _, r), at) in enumerate(zip(late, starts))], "j int, src int, ahead bigint")
        tail = spark.range(ends[-1]).withColumn("j", _place(i, starts)).join(_few(of, len(late)), "j")
        out = out.unionByName(tail.select((i + slots).alias("slot"), "src", (i + F.col("ahead")).alias("rank")))
    return out


def _few(df: DataFrame, rows: int) -> DataFrame:
    """A table of a row a source, broadcast while it is small."""
    return F.broadcast(df) if rows <= BROADCAST_LIMIT // 256 else df


def _order(seed: str) -> Column:
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text)))


def mixed(docs: DataFrame, weights: dict | None = None, block_tokens: int = BLOCK_TOKENS, slots: int | None = None, seed: str = SEED, repeat: int = REPEAT) -> DataFrame:
    """slot, source, epoch, block, start (token of the block), doc_id, token_from, token_to, text: the pieces of the mixture.

    Ordered by slot and start they are the mixture; the pieces of a document, in order, are its whole text. Tokens
    are runs of non-blank characters. A null source is a source; rows with a null text or without tokens have
    nothing to place and give no row, nor does a source without a weight where weights are given. Repeated rows are placed each for itself; very long documents span blocks;
    other columns are ignored; an empty table gives an empty result. Every block of every source is placed at least once, a source
    however small included; see plan for how often others repeat.
    """
    spark = docs.sparkSession
    ship(spark)
    # every use of docs below reads it anew, so only narrow columns are kept of it until the text is placed
    d = docs.select("doc_id", "source", "text", F.regexp_count("text", F.lit(TOKEN)).cast("bigint").alias("n")).where("n > 0")
    d = d.withColumn("h", _order(seed))
    fine = 16**CELL_DIGITS
    cell = F.conv(F.substring("h", 1, CELL_DIGITS), 16, 10).cast("bigint")
    cells = stored(d.groupBy("source", cell.alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("docs")), "mix-cells")
    stats = cells.groupBy("source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect()  # a row for each weight
    names, blocks, points, count, reached = plan({r["source"]: r["n"] for r in stats}, weights, block_tokens, slots, repeat)
    most = max((r["docs"] for r in stats), default=1)
    per = max(1, fine * DOCS_PER_BUCKET // max(most, 1))  # hash cells to a bucket; a bucket of the largest source has about DOCS_PER_BUCKET
    bucket = (F.col("cell") / per).cast("int")
    w = Window.partitionBy("source").orderBy("bucket")
    bases = cells.withColumn("bucket", bucket).groupBy("source", "bucket").agg(F.sum("n").alias("bn")).select(F.col("source").alias("bsource"), F.col("bucket").alias("bbucket"), (F.sum("bn").over(w) - F.col("bn")).alias("base"))
    sources = spark.createDataFrame([(n, i, b) for i, (n, b) in enumerate(zip(names, blocks))], f"ssource {docs.schema['source'].dataType.simpleString()}, ssrc int, blocks bigint")
    w = Window.partitionBy("source", "bucket").orderBy("h")
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = d.withColumn("cell", cell).withColumn("bucket", bucket).select("doc_id", "source", "text", "n", "bucket", "h").withColumn("upto", upto)
    placed = placed.join(bases, F.col("source").eqNullSafe(F.col("bsource")) & (F.col("bucket") == F.col("bbucket")))
    placed = placed.join(_few(sources, len(names)), F.col("source").eqNullSafe(F.col("ssource")))
    end = F.col("base") + F.col("upto")
    placed = placed.select("doc_id", "source", "text", F.col("ssrc").alias("src"), (end - F.col("n")).alias("first"), end.alias("end"))
    size, one, last = F.lit(block_tokens), F.expr(f"first div {block_tokens}"), F.expr(f"(end - 1) div {block_tokens}")
    begin = lambda k: F.greatest(F.col("first"), k * size) - F.col("first")
    stop = lambda k: F.least(F.col("end"), (k + 1) * size) - F.col("first")
    cut = lambda ws, k: F.array_join(F.slice(ws, (begin(k) + 1).cast("int"), (stop(k) - begin(k)).cast("int")), "")
    # the lambda binds the tokens of a text that spans blocks, so that they are told once and not for each piece
    many = F.transform(F.array(F.regexp_extract_all("text", F.lit(SPACED), F.lit(0))), lambda ws: F.transform(F.sequence(one, last), lambda k: F.struct(k.alias("block"), cut(ws, k).alias("text"))))
    parts = F.when(one == last, F.array(F.struct(one.alias("block"), F.col("text").alias("text")))).otherwise(many[0])
    pieces = placed.select("doc_id", "source", "src", "first", "end", F.explode(parts).alias("p"))
    k = F.col("p.block")
    pieces = pieces.select("doc_id", "source", "src", k.alias("block"), (begin(k) + F.col("first") - k * size).alias("start"), begin(k).alias("token_from"), stop(k).alias("token_to"), F.col("p.text").alias("text"))
    s = schedule(spark, points or [0], count, blocks, reached).join(_few(sources.select("ssrc", "blocks"), len(names)), F.col("src") == F.col("ssrc"))
    s = s.select("slot", F.col("src").alias("tsrc"), F.expr("rank div blocks").alias("epoch"), F.expr("rank % blocks").alias("tblock"))
    if (count + sum(blocks)) * 32 <= BROADCAST_LIMIT:
        s = F.broadcast(s)
    out = pieces.join(s, (F.col("src") == F.col("tsrc")) & (F.col("block") == F.col("tblock")))
    return out.select("slot", "source", "epoch", "block", "start", "doc_id", "token_from", "token_to", "text")


def sql(block_tokens: int = BLOCK_TOKENS, seed: str = SEED, documents: str = "documents") -> str:
    """The same, in DuckDB's SQL, for weights by temperature and full coverage."""
    top = 1 << POINT_BITS
    return rf"""
with d as (
  select doc_id, source, text, cast(len(regexp_extract_all(text, '{TOKEN}')) as bigint) as n,
    md5('{seed}:' || coalesce(cast(doc_id as varchar), 'null') || ':' || md5(text)) as h
  from {documents}),
o as (select *, cast(sum(n) over (partition by source order by h rows unbounded preceding) as bigint) as done from d where n > 0),
src as (
  select source, row_number() over (order by source) - 1 as src, cast(sum(n) as bigint) as tokens, cast(ceil(sum(n) / {block_tokens}.0) as bigint) as blocks, pow(cast(sum(n) as double), {TEMPERATURE}) as w
  from o group by source),
cum as (
  select *, least(src + max(raw - src) over (order by src rows unbounded preceding), {top} - count(*) over () + src) as point
  from (select *, cast(round((sum(w) over (order by src rows unbounded preceding) - w) / sum(w) over () * {top}) as bigint) as raw from src)),
size as (select *, lead(point, 1, {top}) over (order by src) - point as size from cum),
total as (
  select cast(least(max((cast(tokens as hugeint) * {top} + {block_tokens} * size - 1) // ({block_tokens} * cast(size as hugeint))), {REPEAT} * sum(blocks)) as bigint) as slots from size),
s as (select range as slot, (range % {top}) * {STEP} % {top} as point from range((select slots from total))),
ranked as (
  select slot, c.src, c.source, c.blocks, row_number() over (partition by c.src order by slot) - 1 as rank
  from s join size c on s.point >= c.point and s.point < c.point + c.size),
late as (
  select c.src, c.source, c.blocks, unnest(range(coalesce(x.reached, 0), c.blocks)) as rank
  from size c left join (select src, count(*) as reached from ranked group by src) x using (src)),
r as (
  select slot, source, blocks, rank from ranked
  union all select (select slots from total) + row_number() over (order by src, rank) - 1, source, blocks, rank from late),
p as (select doc_id, source, text, n, done - n as first, done, unnest(range((done - n) // {block_tokens}, (done - 1) // {block_tokens} + 1)) as block from o),
q as (select *, greatest(first, block * {block_tokens}) - first as token_from, least(done, (block + 1) * {block_tokens}) - first as token_to from p)
select r.slot, q.source, r.rank // r.blocks as epoch, q.block, q.first + q.token_from - q.block * {block_tokens} as start, q.doc_id, q.token_from, q.token_to,
  case when token_to - token_from = n then text
    else array_to_string(list_slice(regexp_extract_all(text, '{SPACED}'), token_from + 1, token_to), '') end as text
from q join r on r.source is not distinct from q.source and r.rank % r.blocks = q.block
"""
