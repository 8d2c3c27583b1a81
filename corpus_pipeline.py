"""Corpus pipeline over ``documents``: each stage calls one operator of ``prefengine.llm``.

Every stage gets what its predecessor kept, written as Parquet and read again.  All but the last
return the columns of ``documents``; the last returns the mix: what it takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prefengine.llm import decontam, mixing, quality, simhash, substrings
from prefengine.llm.common import shared_table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of at least 0.7)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (4-word shingles, at most 4 differing bits)."""
    return simhash.keep_one(docs, shingle=4, bits=4)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that stand anywhere else in the corpus."""
    return substrings.remove_repeats(docs, length=200)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontam.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the words that the mix takes of each."""
    return mixing.mix_digest(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_distinct),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, the fingerprints and the suffix arrays have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
