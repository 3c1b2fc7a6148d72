"""From raw documents to shards: good texts, one of each near duplicate, no benchmark items, mixed, sharded."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from access_engine.llm import decontaminate, mixing, quality, sharding, simhash
from access_engine.storage import settled


def good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def single(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates: three-word SimHash within three bits."""
    return simhash.first_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.copied(docs)


def shard(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every copy."""
    return sharding.sharded(docs)


STAGES = [("quality", good), ("near_duplicates", single), ("decontaminate", clean), ("mix", mix), ("shard", shard)]
#: A learnt classifier and XXH64 can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written and read again.

    A stage's own intermediate tables go once its rows are written; the stages' rows stay.
    """
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES:
        docs = settled(spark, name, partial(stage, spark, docs, folder))
    return docs
