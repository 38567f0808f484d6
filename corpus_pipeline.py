"""From raw documents to packed token sequences: filter, deduplicate, decontaminate, pack.

Every stage takes what the one before it kept, as a written table, and returns the columns of
``documents``; the last returns the places of all pieces in their sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm.decontaminate import drop_contaminated
from tokenloom.llm.packing import best_two_fit
from tokenloom.llm.quality_rules import keep_by_rules
from tokenloom.llm.repeats import remove_repeats
from tokenloom.llm.simhash import keep_one_of_each
from tokenloom.session import materialize

# A passage of 51 words can be far shorter than the 400 bytes of op4: one in a hundred of the
# shortest such windows of sf0.1's documents has under 257 bytes, one in a thousand under 152.
REPEAT_BYTES = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return keep_by_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return keep_one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated strings of ``REPEAT_BYTES``."""
    return remove_repeats(docs, REPEAT_BYTES)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2,048."""
    return best_two_fit(docs)


STAGES = [
    ("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("suffix_dedup", repeats),
    ("decontamination", decontamination), ("best_fit_packing", packing),
]

# Suffix order, locality-sensitive groups and packing have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
