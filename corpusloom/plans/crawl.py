"""Breadth-first expansion of a link graph, one join a level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import BUCKETS, bucketed, pruned
from ..runtime import stored
from ..sources import robots
from ..sources.sitemap import sitemap_url


def save_visited(visited: DataFrame, path: str) -> None:
    """page, depth: the state of a crawl, for a later run."""
    visited.select("page", F.col("depth").cast("int").alias("depth")).write.mode("overwrite").parquet(path)


def load_visited(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("page string, depth int").parquet(path)


def save_links(links: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """The bank of links by the page they are on (src_id), with all their columns."""
    bucketed(links, "src_id", path, buckets)


def links_of(spark: SparkSession, path: str, pages: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The links of some pages (src_id), from the folders of the bank that hold them."""
    pages = pages.select("src_id").distinct()
    return pruned(spark.read.parquet(path), "src_id", pages, buckets).join(pages, "src_id", "left_semi").drop("bucket")


def page_rules(pages: DataFrame, robots_files: DataFrame, agent: str) -> DataFrame:
    """Adds to pages (url, host, path) whether the agent may fetch them, the delay of their host, and where their sitemap is. robots_files: host, body."""
    return robots.allowed(pages, robots.rules(robots_files), agent).withColumn("sitemap", sitemap_url(F.col("url")))


def frontier(seeds: DataFrame, edges: DataFrame, max_depth: int, visited: DataFrame | None = None) -> DataFrame:
    """page, depth: the least number of links from a seed, for pages nearer than max_depth.

    visited: page, depth of an earlier run; a page that was met as near then is not met, nor followed, again.

    seeds: page; edges: src, dst. Each level joins the last one's pages with the edges and drops those known already; it is written to the shared
    folder, so lineage does not grow and a lost executor costs one level at most. Null pages and repeated edges change nothing.
    """
    level = stored(seeds.select("page").where("page is not null").distinct().select("page", F.lit(0).alias("depth")), "crawl")
    seen = level
    for depth in range(1, max_depth):
        known = seen if visited is None else seen.unionByName(visited.where(F.col("depth") <= depth).select(F.col("page").cast(seen.schema["page"].dataType), "depth"))
        new = edges.join(level.select(F.col("page").alias("src")), "src").select(F.col("dst").alias("page")).where("page is not null").distinct()
        level = stored(new.join(known.select("page"), "page", "left_anti").select("page", F.lit(depth).alias("depth")), "crawl")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def domain_edges(links: DataFrame, only_same_domain: bool) -> DataFrame:
    """Links as edges, those to other domains left out if so configured."""
    kept = links.where("same_domain") if only_same_domain else links
    return kept.select(F.col("base").alias("src"), F.col("link").alias("dst"))
