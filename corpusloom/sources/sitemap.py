"""Sitemap tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import absolute_url, same_origin
from ..runtime import ship

PROTOCOL = "www.sitemaps.org"
NAMESPACE = f' xmlns="http://{PROTOCOL}/schemas/sitemap/0.9"'


def sitemap_url(url: Column) -> Column:
    """The URL itself if it names a sitemap, else the one beside it."""
    return F.when(F.contains(url, F.lit("sitemap")), url).otherwise(F.concat(F.regexp_replace(url, "/$", ""), F.lit("/sitemap.xml")))


def locations(sitemaps: DataFrame) -> DataFrame:
    """base_url, xml -> base_url, ord, loc of every loc element at any depth. An empty body has none; malformed XML fails the query."""
    xml = F.replace(F.regexp_replace("xml", "^﻿", ""), F.lit(NAMESPACE), F.lit(""))
    return sitemaps.where("trim(xml) <> ''").select("base_url", F.posexplode(F.xpath(xml, F.lit("//loc/text()"))).alias("ord", "loc"))


def links(sitemaps: DataFrame, only_same_domain: bool = False) -> DataFrame:
    """base_url, ord, link, same_domain of the usable locations."""
    ship(sitemaps.sparkSession)
    out = locations(sitemaps).withColumn("link", absolute_url(F.trim("loc"), F.col("base_url"))).where("link is not null")
    out = out.withColumn("same_domain", same_origin(F.col("link"), F.col("base_url"))).drop("loc")
    return out.where("same_domain") if only_same_domain else out
