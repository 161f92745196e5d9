"""A corpus pipeline: quality, toxicity, near-duplicates, benchmark leaks, mixing.

Each stage takes all that its predecessor kept, written as Parquet and read again. All but
the last return the columns of documents; the last adds size, source_size, target and taken
to the documents that the mix takes. Null texts score as empty ones, stand alone as
near-duplicates, leak nothing and have size 0, so that the mix takes none of them; an empty
table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomdoc.llm.common import settle, table, tidy
from loomdoc.llm.decontam import drop_leaks
from loomdoc.llm.mixing import mix
from loomdoc.llm.neardup import drop_near_copies
from loomdoc.llm.quality import keep_good
from loomdoc.llm.toxicity import drop_toxic


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity classifier rejects."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that overlap an item of the benchmark."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how many words of each."""
    return mix(docs)


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The classifiers and ProbMinHash are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage keeps. What the others wrote is removed when it is there."""
    docs = table(spark, sf_dir, "documents")
    with tidy(spark) as keep:
        for name, stage in STAGES:
            with tidy(spark) as done:
                docs = done(settle(stage(spark, docs, sf_dir), name))
        return keep(docs)
