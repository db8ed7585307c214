"""Corpus pipeline: language ID, near duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir), docs being what its predecessor kept, and all
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstrata.llm import decontam, langid, mixing, ngram_join, sharding
from quillstrata.llm.common import cut, small_batches, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, which no language claims, go."""
    small_batches(spark)
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8, one row of the smallest id stays."""
    small_batches(spark)
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard, slot and digest columns."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]

#: Language ID is a trained model, which SQL cannot express; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  Stages that run Python ask for small Arrow batches; the
    session's own number is back in force at the end, when the last stage, which is native,
    is still to be computed."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = table(spark, sf_dir, "documents")
    try:
        for i, (stage, apply) in enumerate(STAGES):
            docs = apply(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                docs = cut(docs, stage)
    finally:
        spark.conf.set(name, before)
    return docs
