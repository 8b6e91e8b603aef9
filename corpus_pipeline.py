"""A corpus pipeline over ``documents``: five stages, each stored as Parquet and read again by the next one.

Language identification and quality rules reject documents, near duplicates leave one of each group, mixing deals the
rest out to target weights, and packing cuts it into sequences.  Mixing decides the order in which rows lie in its
files; packing ranks documents of a length class by that order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import jaccard, langid, mixing, packing, quality
from tallyloom.llm.scratch import bound_batches, materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a clear language: those without letters go, and long ones that no language fits."""
    bound_batches(spark)
    return langid.keep_identified(docs, langid.fit(docs.filter(langid.training_rows(docs))))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not rejected."""
    bound_batches(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    bound_batches(spark)
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that interleaves sources by the square root of their sizes."""
    bound_batches(spark)
    return mixing.in_mixed_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, documents ranked as mixing laid them down."""
    bound_batches(spark)
    return packing.pack(docs, packing.tokenizer_path(), order=mixing.file_order(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: SQL cannot express the language model, the schedule or the packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
