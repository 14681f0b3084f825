"""Connected components of an edge table by alternating stars, with each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stored


def _mark(edges: DataFrame):
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges -> (node, root): root is the least node of the component; nodes without an edge are not in it."""
    e = stored(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    mark = _mark(e)
    while mark[0]:
        # large star: neighbours above u hang below the least of u and its neighbours; a hub's are aggregated before they are shuffled
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        big = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc")
        # small star: the lesser neighbours of u, and u, hang below the least of them
        near = big.join(big.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = stored(small, "cc")
        new = _mark(e)
        if new == mark:
            break
        mark = new
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
