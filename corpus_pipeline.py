"""Corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before
kept, and returns a DataFrame; ``run`` writes it as Parquet in the shared
folder and hands the table on.  All stages but the last return the columns of
``documents``; the last adds size, text_crc32, law, shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from medialake.llm import decontaminate, langid, mixing, sharding, simhash
from medialake.llm.common import materialise, release, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a clear language."""
    return langid.keep_clear(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that token shares of source, language and topic meet the tempered targets."""
    return mixing.mix(docs)


def shard_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals documents to eight shards of near equal bytes."""
    return sharding.shard(docs, 8)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("sharding", shard_files),
]

#: Language ID is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = written()
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
        release(spark, before, newest=1)  # what the stages before and this one wrote on the way
    return docs
