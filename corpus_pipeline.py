"""The corpus pipeline: documents in, a scheduled mixture out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontam, langid, mixing, near_dup, pii
from corpusloom.runtime import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages that lang names go. The classifiers are fitted on a bounded sample of docs.

    Null and empty texts and those without letters go; repeated rows stay or go together, as do rows of one text; whole texts are read
    whatever their length; of tied languages the first by name counts; other columns, whatever their names, are kept; an empty table stays empty.
    """
    return langid.accepted(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least doc_id stays; rows with a null text all stay.

    Empty texts are copies of each other; a null doc_id counts as the greatest, and of tied rows (one doc_id) that with the least hash of
    its text stays, of repeated rows any one; whole texts are compared; other columns are kept; an empty table stays empty.
    """
    return near_dup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go.

    Null and empty texts stay; null, empty and very short items match nothing; repeated rows stay or go together; whole texts are searched;
    without items all stay; other columns are kept; an empty table stays empty.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms; every document stays.

    Null and empty texts stay as they are; equal values, in repeated rows or elsewhere, become equal; whole texts are rewritten; n_chars is
    the length of the new text; other columns are kept; an empty table stays empty.
    """
    return pii.pseudonymized(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The scheduled blocks with their text; every document with a token is in it at least once.

    Null, empty and blank texts have nothing to place; a null source is a source; repeated rows are placed each for itself; very long texts
    span blocks; rows tied in the order (one doc_id and text) are alike; other columns are ignored; an empty table gives an empty result.
    """
    return mixing.mixed(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("mixture", mixture),
]

ORACLE_SQL = None  # kernels, edit distance and Feistel networks are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
