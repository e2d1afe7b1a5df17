"""A training corpus from raw documents: language, copies, repeats, mix, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import balance, language, minmax_dedup, packing, suffix_dedup
from claimloom.llm.common import Scratch

REPEAT_BYTES = 200  # a passage of fifty words and more is longer


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and whose text is usual for it."""
    return language.accepted_documents(docs, language.learn(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    return minmax_dedup.kept_documents(docs, words=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document, or place, holds already."""
    return suffix_dedup.without_repeats(docs, length=REPEAT_BYTES)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return balance.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("languages", languages),
    ("near_copies", near_copies),
    ("repeats", repeats),
    ("mixture", mixture),
    ("sequences", sequences),
]

# Models, hashes and tokenisers have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written as Parquet and read by the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.store(stage(spark, docs, sf_dir))
        scratch.release()
    return docs
