"""Spelling correction of query words by character n-grams and edit distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import Index, ngrams, pruned

NGRAM = 3
MAX_TYPO = 2


def candidates(queries: DataFrame, words: DataFrame | Index, n: int = NGRAM) -> DataFrame:
    """word, candidate, pos, first_seen: the vocabulary words that share an n-gram with a query word.

    They are ordered by the place in the query word of the first n-gram they share, then by where they were first seen. Of an index with stored
    n-grams of that length only the folders of the query's are read.
    """
    wanted = ngrams(queries.select("word").distinct(), n).select(F.col("word").alias("asked"), "gram_pos", "ngram")
    if isinstance(words, Index) and words.grams is not None and words.ngram == n:
        listed = pruned(words.grams, "ngram", wanted, words.buckets)
    else:
        listed = ngrams(words.words if isinstance(words, Index) else words, n)
    listed = listed.select(F.col("word").alias("candidate"), "first_seen", "ngram")
    hits = listed.join(F.broadcast(wanted) if queries.count() < 100_000 else wanted, "ngram")
    return hits.groupBy(F.col("asked").alias("word"), "candidate").agg(F.min("gram_pos").alias("pos"), F.first("first_seen").alias("first_seen"))


def within(found: DataFrame, max_typo: int = MAX_TYPO) -> DataFrame:
    """Candidates within the edit distance, with it."""
    near = found.where(F.abs(F.length("word") - F.length("candidate")) <= max_typo)
    return near.withColumn("distance", F.levenshtein("word", "candidate", max_typo)).where("distance >= 0")


def replacements(queries: DataFrame, words: DataFrame | Index, n: int = NGRAM, max_typo: int = MAX_TYPO, mode: str = "first") -> DataFrame:
    """word, replacement: the first candidate within the distance, or with mode="nearest" the first of the nearest; else the word."""
    near = within(candidates(queries, words, n), max_typo)
    order = [F.col("distance")] if mode == "nearest" else []
    best = near.groupBy("word").agg(F.min_by("candidate", F.struct(*order, "pos", "first_seen")).alias("replacement"))
    return queries.select("word").distinct().join(best, "word", "left").select("word", F.coalesce("replacement", "word").alias("replacement"))
