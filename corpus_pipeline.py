"""Corpus preparation: documents of a known language, one of each group of near copies, without repeated passages and personal data,
packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written and read again as the next one's ``docs``. All but the
last keep the columns of ``documents``. Stages stand for themselves: null texts, repeated rows, empty tables and columns beyond the
usual ones pass through as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runlens.llm import language, packing, pii, recompression, similarity
from runlens.session import written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and those whose languages are all equally likely."""
    return language.known_language(docs)


def similar_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays. SimHash fingerprints within four bits, and bands of least hashes for those
    further apart, propose pairs; similarities of 0.8 and more between sets of five-word shingles join them."""
    return similarity.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document, or before in the same, are cut out."""
    return recompression.without_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the names of their kinds."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language", known_language),
    ("near_copies", similar_texts),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Fingerprints and tokens are beyond SQL; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
