"""python -m corpusloom index CONFIG PAGES | search CONFIG [QUERY...]: pages (Parquet with page_id, url, html) to an index, and questions to it.

The configuration names the folder of the index and what corrects spelling. Without a query on the command line, queries are read line by line until q.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import index as I
from .operators import search as S
from .runtime import ship
from .sources import html


def index(spark: SparkSession, config: Config, pages_path: str) -> int:
    """Index all pages; returns the number of documents."""
    ship(spark)
    pages = spark.read.parquet(pages_path)
    if {"status", "content_type"} <= set(pages.columns):
        pages = html.usable(pages)
    x = I.build(pages.select(F.col("page_id").alias("doc_id"), "url"), html.passages(html.parsed(pages)))
    x.save(config.index_path, ngram=config.ngram_count)
    return I.Index.load(spark, config.index_path).documents.count()


def answer(spark: SparkSession, config: Config, texts: list[str], limit: int = S.LIMIT) -> list[tuple[int, int, str]]:
    """(query, number, URL) of the first documents of each query."""
    x = I.Index.load(spark, config.index_path)
    q = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    terms = S.query_terms(q, x, ngram=config.ngram_count, max_typo=config.max_typo)
    return [tuple(r) for r in S.presented(S.ranked(S.features(terms, x), limit)).collect()]


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("index", "search") or (args[0] == "index") != (len(args) == 3 and args[0] == "index"):
        print(__doc__, file=sys.stderr)
        return 2
    config = Config.load(args[1])
    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    if args[0] == "index":
        print(f"{index(spark, config, args[2])} documents")
        return 0
    for text in [" ".join(args[2:])] if len(args) > 2 else iter(lambda: input("> ").strip(), "q"):
        begun = time.time()
        for _, n, url in answer(spark, config, [text]):
            print(f"{n}. {url}")
        print(f"({time.time() - begun:.2f} s)")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
