"""Incremental indexing: a stream of page files to an index that can be searched meanwhile.

Each micro-batch is indexed as a batch is and written to its own folder, overwritten if the batch is repeated; readers take the folders that are
complete. A page whose URL came before replaces it (the latest batch wins); content that was indexed before becomes an alias.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.urls import document_id
from ..operators import index as I
from ..operators import tokens as T
from ..runtime import ship
from ..sources import html

PAGES = "page_id bigint, url string, html string"


def indexed(pages: DataFrame, open_entities: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents (doc_id, url, content_hash, word_count), postings and n-gram words of a batch of pages, one page a URL."""
    ship(pages.sparkSession)
    one = pages.withColumn("doc_id", F.hex(document_id(F.col("url")))).where("doc_id is not null")
    # of several pages of one URL the last by page_id, text on a tie: by rule, as each of the three tables tells them anew
    one = one.groupBy("doc_id").agg(F.max(F.struct("page_id", "url", "html")).alias("p")).select("doc_id", "p.*")
    passages = html.passages(html.parsed(one, key="doc_id", open_entities=open_entities, hrefs=False), "doc_id")
    d = I.lengths(one, T.indexed(passages)).join(one.select("doc_id", "url"), "doc_id").join(I.content_hash(passages), "doc_id", "left")
    return d, I.posted(passages), I.vocabulary(passages)


def ingest(spark: SparkSession, landing: str, store: str, interval: str | None = None, files_per_trigger: int = 100, open_entities: bool = True) -> StreamingQuery:
    """Index all pages that land as Parquet files: those there now, or with an interval ("1 second") for good. open_entities: as in html.parse."""

    def batch(pages: DataFrame, batch_id: int) -> None:
        parts = dict(zip(("documents", "postings", "words"), indexed(pages, open_entities)))
        pages.persist()
        for name, df in parts.items():
            df.write.mode("overwrite").parquet(f"{store}/{name}/batch_id={batch_id}")
        pages.unpersist()

    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(landing)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", os.path.join(store, "_progress"))
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def snapshot(spark: SparkSession, store: str) -> I.Index:
    """The index as of now. Of a document's versions the latest counts; repeated content keeps a document, but no postings."""
    docs = spark.read.parquet(f"{store}/documents")
    latest = docs.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("batch_id")))).where("n = 1").drop("n")
    # boilerplate may be the content of very many pages, so the first of each is aggregated, not ranked in one task
    first = latest.groupBy("content_hash").agg(F.min(F.struct("batch_id", "doc_id")).alias("first"))
    latest = latest.join(first, "content_hash", "left").withColumn("is_alias", F.coalesce(F.col("first.doc_id") != F.col("doc_id"), F.lit(False))).drop("first")
    postings = spark.read.parquet(f"{store}/postings").join(latest.where("not is_alias").select("doc_id", "batch_id"), ["doc_id", "batch_id"], "left_semi")
    words = spark.read.parquet(f"{store}/words").groupBy("word").agg(F.min(F.struct("batch_id", "first_seen")).alias("first_seen"))
    return I.Index(latest.drop("batch_id", "content_hash"), postings.drop("batch_id"), words)
