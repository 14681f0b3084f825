"""The inverted index: documents, postings, vocabulary and corpus statistics, as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stored
from . import blocks

POSITIONS = 500  # positions kept of a term in a document; its frequency is not cut


def postings(positioned: DataFrame) -> DataFrame:
    """doc_id, term, tf, positions of tokens with their places. posted makes the same of passages, without a row for each token."""
    at = F.array_sort(F.collect_list(F.struct(F.col("pos").alias("i"), "type")))
    return positioned.groupBy("doc_id", "term").agg(F.count("*").cast("int").alias("tf"), F.slice(at, 1, POSITIONS).alias("positions"))


def posted(passages: DataFrame) -> DataFrame:
    """doc_id, term, tf, positions."""
    return blocks.postings(passages, POSITIONS)


def lengths(documents: DataFrame, indexed: DataFrame) -> DataFrame:
    """doc_id and word_count of every document, those without a token too."""
    n = indexed.groupBy("doc_id").agg(F.count("*").alias("n"))
    return documents.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("int").alias("word_count"))


def vocabulary(passages: DataFrame) -> DataFrame:
    """word and first_seen of the words that feed the character n-grams: no stop words, unstemmed, of any length.

    first_seen orders words as they first come: by document, passage and place among the passage's different words.
    """
    w = blocks.first_words(passages).groupBy("word").agg(F.min(F.struct("doc_id", "place")).alias("first_seen"))
    return w.select("word", "first_seen")


def ngrams(words: DataFrame, n: int = 3, word: str = "word") -> DataFrame:
    """The distinct n-grams of each word with the place of the first of each; shorter words have none."""
    size = F.length(word)
    grams = F.when(size >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(F.col(word), i, F.lit(n)))))
    return words.select("*", F.posexplode(grams).alias("gram_pos", "ngram"))


def content_hash(passages: DataFrame) -> DataFrame:
    """doc_id, content_hash: SHA-256 over the passages in their order, types included."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "type", "text")))
    return passages.groupBy("doc_id").agg(F.sha2(F.to_json(F.transform(listed, lambda p: F.struct(p["text"].alias("text"), p["type"].alias("type")))), 256).alias("content_hash"))


def deduplicated(hashed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds first_id, the least id with the same content; it is an alias where that is another one."""
    # a hash that many share is aggregated before it is joined; only those that repeat are
    hashed = stored(hashed, "hashes")
    first = hashed.groupBy("content_hash").agg(F.min(key).alias("first_id"), F.count("*").alias("n")).where("n > 1").select("content_hash", "first_id")
    out = hashed.join(first, "content_hash", "left").withColumn("first_id", F.coalesce("first_id", key))
    return out.withColumn("is_alias", F.col(key) != F.col("first_id"))


BUCKETS = 64
SORTED = 1 << 19  # postings that a task sorts; of one term there may be more


def bucket(key: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def bucketed(df: DataFrame, key: str, path: str, n: int = BUCKETS) -> None:
    """Write to folders by a hash of the key, each sorted by it: a look-up reads few of them, and of those few row groups."""
    b = df.withColumn("bucket", bucket(key, n))
    b.repartition(n, "bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(path)


def pruned(stored: DataFrame, key: str, wanted: DataFrame, n: int | None) -> DataFrame:
    """Of a table that bucketed wrote only the folders that hold one of the wanted keys; any other table as it is. wanted should be stored, or small."""
    if n is None or "bucket" not in stored.columns:
        return stored
    named = [r["b"] for r in wanted.select(bucket(key, n).alias("b")).distinct().collect()]  # at most n
    return stored.where(F.col("bucket").isin(named)) if len(named) < n else stored


@dataclass
class Index:
    documents: DataFrame  # doc_id, url, word_count, and word_vec if vectors are known
    postings: DataFrame  # doc_id, term, tf, positions
    words: DataFrame  # word, first_seen
    grams: DataFrame | None = None  # ngram, word, first_seen, if stored
    buckets: int | None = None  # folders of a saved index
    ngram: int = 3  # letters of the stored n-grams

    def statistics(self) -> DataFrame:
        """One row: the number of documents and their mean length."""
        return self.documents.agg(F.count("*").alias("n_docs"), F.avg("word_count").alias("avg_len"))

    def document(self, ids: DataFrame) -> DataFrame:
        """The documents with one of the ids (doc_id); others have no row, and a repeated id has one."""
        ids = ids.select("doc_id").distinct()
        return pruned(self.documents, "doc_id", ids, self.buckets).join(ids, "doc_id", "left_semi").drop("bucket")

    def save(self, path: str, buckets: int = BUCKETS, ngram: int = 3) -> None:
        """documents, postings and n-grams of words by what they are looked up by; and words."""
        bucketed(self.documents, "doc_id", f"{path}/documents", buckets)
        self._save_postings(f"{path}/postings", buckets)
        self.words.write.mode("overwrite").parquet(f"{path}/words")
        words = self.words.sparkSession.read.parquet(f"{path}/words")
        bucketed(ngrams(words, ngram).select("ngram", "word", "first_seen"), "ngram", f"{path}/grams", buckets)
        self.words.sparkSession.createDataFrame([(buckets, ngram)], "buckets int, ngram int").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")

    def _save_postings(self, path: str, buckets: int) -> None:
        """As bucketed does, but the shuffle takes packed postings, and the hash parts a folder further, so that no task sorts more than fits its memory."""
        p = self.postings.select("doc_id", "term", "tf", "positions")
        parts = buckets * max(1, -(-p.count() // (buckets * SORTED)))
        moved = blocks.packed(p.withColumn("part", bucket("term", parts))).repartitionById(parts, "part")
        b = blocks.unpacked(moved, p.schema).withColumn("bucket", bucket("term", buckets))
        b.sortWithinPartitions("bucket", "term").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> Index:
        d, p, w, g, layout = (spark.read.parquet(f"{path}/{name}") for name in ("documents", "postings", "words", "grams", "layout"))
        return cls(d, p, w, g, *layout.first())


def build(documents: DataFrame, passages: DataFrame, vectors: DataFrame | None = None) -> Index:
    """documents: doc_id, url. vectors: doc_id, word_vec (array<array<double>>). Postings are computed once and stored; lengths are their sums."""
    p = stored(posted(passages), "index-postings", compression="zstd")
    n = p.groupBy("doc_id").agg(F.sum("tf").alias("n"))
    d = documents.select("doc_id", "url").join(n, "doc_id", "left").select("doc_id", "url", F.coalesce("n", F.lit(0)).cast("int").alias("word_count"))
    if vectors is not None:
        d = d.join(vectors.select("doc_id", "word_vec"), "doc_id", "left")
    return Index(d, p, stored(vocabulary(passages), "index-words"))
