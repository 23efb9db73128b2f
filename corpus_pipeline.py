"""Training corpus from raw documents, stage by stage.

Every stage takes (spark, docs, sf_dir) and gives back documents with their
columns as they were, the last one a manifest of the shards.  Stages are joined
by Parquet tables, so each reads what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import decontamination, language, mixing, near_dup, sharding
from gleanery.llm.common import Scratch, table

SHARDS = 8
#: Words of a shingle of the near-duplicate stage.
SHINGLE = 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language that the labelled documents teach; the others go."""
    return language.in_known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id."""
    return near_dup.without_near_duplicates(docs, SHINGLE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources has them."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix, copies included."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]
#: Stages beyond SQL: filters of hashed n-grams, components, hashed draws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``; what a stage hands on is a table
    in the shared folder, and goes when the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if at:
            scratch.drop(STAGES[at - 1][0])
    return docs
