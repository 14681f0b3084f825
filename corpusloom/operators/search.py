"""Batched ranked search over an index.

Query terms drive: they are few and broadcast, so only their postings are read; what is left is partitioned by (query, document) once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, euclid, mean_over, truncated
from ..functions.words import with_stem
from ..runtime import stored
from . import spell
from . import tokens as T
from .index import Index, pruned

K1, B = 1.2, 0.75
NO_MATCH = 9223372036854775807  # stands for "no proximity" where queries are ranked
LIMIT = 100
EPSILON = 2.0**-52
WIDTH = 10  # classes of the interleaved re-ranking
MANY = 100_000  # queries or query terms; tables of more are not broadcast


def _few(n: int):
    """A broadcast hint for tables made from n rows, if those are few; else none."""
    return F.broadcast if n <= MANY else lambda df: df


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(n_docs / (df + 1)) + 1


def bm25(idf: Column, tf: Column, length: Column, mean: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.try_divide(length.cast("double"), mean)))


def query_terms(queries: DataFrame, index: Index, correct: bool = True, mode: str = "first", ngram: int = spell.NGRAM, max_typo: int = spell.MAX_TYPO) -> DataFrame:
    """query_id, slot, term, n_slots. Numbers and repeats keep their slots; a word without postings is replaced if another is near."""
    p = queries.select(F.col("query_id").alias("doc_id"), F.lit(0).alias("ord"), F.lit("q").alias("type"), "text")
    t = T.stemmed(T.tokens(p))
    w = Window.partitionBy("doc_id").orderBy("tok")
    t = stored(t.select(F.col("doc_id").alias("query_id"), (F.row_number().over(w) - 1).alias("slot"), "token", "class", "term"), "query-tokens")
    if correct:
        few = _few(queries.count())
        asked = t.select("term").distinct()
        known = pruned(index.postings, "term", asked, index.buckets).join(few(asked), "term", "left_semi").select("term").distinct()
        unknown = stored(t.where("class = 'WORD'").join(known, "term", "left_anti").select(F.col("token").alias("word")).distinct(), "query-unknown")
        fixed = spell.replacements(unknown, index, ngram, max_typo, mode).where("word <> replacement")
        fixed = with_stem(fixed.select(F.col("word").alias("token"), "replacement"), "replacement", "better").select("token", "better")
        t = t.join(few(fixed), "token", "left").withColumn("term", F.when(F.col("class") == "WORD", F.coalesce("better", "term")).otherwise(F.col("term")))
    n = F.count("*").over(Window.partitionBy("query_id"))
    return t.select("query_id", "slot", "term", n.alias("n_slots"))


def proximity(lists: Column) -> Column:
    """lists: arrays of positions, one for each slot. The least last minus first of chains of rising positions; null if there is none."""
    first = lists[0]
    chain = lambda s: F.aggregate(F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(1))), s, lambda at, l: F.array_min(F.filter(l, lambda x: x > at))) - s
    return F.array_min(F.filter(F.transform(first, chain), lambda d: d.isNotNull()))


def self_proximity(postings: DataFrame, n: int) -> DataFrame:
    """doc_id, term, span: the least distance of a position to the (n - 1)-th after it; terms with fewer have none."""
    at = F.array_sort("positions.i")
    spans = F.zip_with(F.slice(at, F.lit(n), F.size(at) - (n - 1)), F.slice(at, F.lit(1), F.size(at) - (n - 1)), lambda z, a: z - a)
    return postings.where(F.size("positions") >= n).select("doc_id", "term", F.array_min(spans).alias("span"))


def words_in_url(url: Column, terms: Column) -> Column:
    """The summed length of the terms that the URL holds, upper and lower case alike."""
    return F.aggregate(F.filter(terms, lambda t: F.contains(F.lower(url), t)), F.lit(0), lambda s, t: s + F.length(t))


def features(terms: DataFrame, index: Index, vectors: DataFrame | None = None) -> DataFrame:
    """A row for each query and document that has one of its terms, with all ranking features.

    vectors: query_id, query_vec; without it, or without vectors of the documents, the vector features are null.
    """
    terms = stored(terms, "query-terms")
    few = _few(terms.count())
    found = pruned(index.postings, "term", terms, index.buckets).select("doc_id", "term", "tf", "positions")
    hits = found.join(few(terms), "term")
    df = found.join(few(terms.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    stats = F.broadcast(index.statistics())
    has_vec = "word_vec" in index.documents.columns and vectors is not None
    d = index.documents.select("doc_id", "url", "word_count", *(["word_vec"] if has_vec else []))
    hits = hits.join(few(df), "term").join(d.drop("word_vec"), "doc_id").crossJoin(stats)
    w = idf(F.col("n_docs"), F.col("df"))
    hits = hits.withColumn("idf", w).withColumn("score", bm25(F.col("idf"), F.col("tf"), F.col("word_count"), F.col("avg_len")))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("slot", F.col("positions.i").alias("at")))), lambda x: x["at"])
    f = hits.groupBy("query_id", "doc_id").agg(
        F.first("url").alias("url"), F.first("word_count").alias("word_count"), F.first("n_slots").alias("n_slots"), F.sum("tf").alias("sum_token_in_package"),
        F.sum(F.col("word_count") * F.col("idf")).alias("tf_idf"), F.sum("score").alias("bm25"), F.count("*").alias("covered"), F.sum(F.size("positions")).alias("n_positions"),
        F.bool_or(F.exists("positions", lambda p: p["type"] == "h")).alias("words_in_header"), lists.alias("lists"),
    )
    asked = terms.groupBy("query_id").agg(F.collect_list("term").alias("terms"))
    f = f.join(few(asked), "query_id")
    in_url = words_in_url(F.col("url"), F.col("terms"))
    f = f.select(
        "query_id", "doc_id", "url", "word_count", "sum_token_in_package", "tf_idf", "bm25", (F.col("covered") / F.col("n_slots")).alias("query_coverage"),
        F.try_divide(F.col("covered"), F.col("n_positions")).alias("query_dencity"), F.when(F.col("covered") == F.col("n_slots"), proximity(F.col("lists"))).alias("term_proximity"),
        "words_in_header", (in_url > 0).alias("word_in_url"), F.log1p(in_url).alias("log_len_words_in_url"), F.octet_length("url").alias("len_url"),
    )
    if not has_vec:
        return f.withColumns({"cos": F.lit(None).cast("double"), "euclid_dist": F.lit(None).cast("double")})
    f = f.join(few(vectors.select("query_id", "query_vec")), "query_id", "left").join(d.select("doc_id", "word_vec"), "doc_id")
    v, q = F.col("word_vec"), F.col("query_vec")
    return f.withColumn("cos", mean_over(v, q, cosine)).withColumn("euclid_dist", mean_over(v, q, euclid)).drop("word_vec", "query_vec")


def order() -> list[Column]:
    return [
        truncated(F.col("cos")).desc_nulls_last(), truncated(F.col("euclid_dist")).asc_nulls_last(), F.round("bm25", 9).desc_nulls_last(),
        F.coalesce("term_proximity", F.lit(NO_MATCH)).desc(), F.round("tf_idf", 9).desc_nulls_last(), F.col("doc_id").asc(),
    ]


def ranked(featured: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds rank (from 0) in each query and keeps the first ones; Spark cuts each partition to the limit before the shuffle."""
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(*order()))
    return featured.withColumn("rank", n).where(F.col("rank") <= limit).withColumn("rank", F.col("rank") - 1)


MODEL_COLUMNS = ("cos", "euclid_dist", "sum_token_in_package", "words_in_header", "query_coverage", "query_dencity", "term_proximity", "words_in_header", "log_len_words_in_url", "len_url")


def standardized(df: DataFrame, columns: tuple[str, ...], by: list[str]) -> DataFrame:
    """Adds z_0, z_1, ...: the columns less their mean over their population deviation (1 where all values are equal) in each group. A missing value is 0."""
    w = Window.partitionBy(*by)
    z = {}
    for i, c in enumerate(columns):
        x = F.coalesce(F.col(c).cast("double"), F.lit(float(NO_MATCH))) if c == "term_proximity" else F.col(c).cast("int").cast("double") if c == "words_in_header" else F.col(c).cast("double")
        x = F.coalesce(x, F.lit(0.0))
        s, mean, n = F.stddev_pop(x).over(w), F.avg(x).over(w), F.count(x).over(w)
        # what rounding leaves of the deviation of equal values is none
        constant = s * s <= n * EPSILON * s * s + (n * mean * EPSILON) * (n * mean * EPSILON)
        z[f"z_{i}"] = (x - mean) / F.when(constant, 1.0).otherwise(s)
    return df.withColumns(z)


def reranked(top: DataFrame, weights: list[float], bias: float = 0.0, columns: tuple[str, ...] = MODEL_COLUMNS) -> DataFrame:
    """Ranks after the interleaved re-ranking by a linear model.

    Positions p of one p mod 10 are a class; in each class of two or more the first member whose relevance is above 0 changes places with its
    head. A class with no such member ends it: that class and the later ones stay as they were. Missing features are 0.
    """
    t = top.withColumn("cls", F.col("rank") % WIDTH).withColumn("slot", F.floor(F.col("rank") / WIDTH))
    t = standardized(t, columns, ["query_id", "cls"])
    score = sum((F.col(f"z_{i}") * w for i, w in enumerate(weights)), F.lit(bias))
    w = Window.partitionBy("query_id", "cls")
    t = t.withColumn("relevance", score).withColumn("size", F.count("*").over(w))
    t = t.withColumn("winner", F.min(F.when(F.col("relevance") > 0, F.col("slot"))).over(w))
    stop = F.min(F.when((F.col("size") > 1) & F.col("winner").isNull(), F.col("cls"))).over(Window.partitionBy("query_id"))
    go = (F.col("size") > 1) & (F.col("cls") < F.coalesce(stop, F.lit(WIDTH)))
    slot = F.when(go & (F.col("slot") == F.col("winner")), 0).when(go & (F.col("slot") == 0), F.col("winner")).otherwise(F.col("slot"))
    return t.withColumn("rank", (slot * WIDTH + F.col("cls")).cast("int")).select(*top.columns)


def search(queries: DataFrame, index: Index, limit: int = LIMIT, vectors: DataFrame | None = None, weights: list[float] | None = None, bias: float = 0.0, correct: bool = True) -> DataFrame:
    """queries: query_id, text -> the first documents of each query with rank and features. Without weights there is no re-ranking."""
    top = ranked(features(query_terms(queries, index, correct), index, vectors), limit)
    return top if weights is None else reranked(top, weights, bias)


def presented(results: DataFrame) -> DataFrame:
    """What is shown: number and URL."""
    return results.select("query_id", (F.col("rank") + 1).alias("number"), "url").orderBy("query_id", "number")
