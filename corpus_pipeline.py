"""The corpus pipeline: quality, near duplicates, benchmark leaks, mixing, sharding.

Each stage reads the Parquet its predecessor wrote and keeps the columns of ``documents``; the last adds the
place of each row in its shard.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import decontaminate, mixing, quality, sharding, simhash
from tillroll.llm.common import shipped, table
from tillroll.sources.scratch import drop, hold, intermediates


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts, learned from ``labels``."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts whose SimHashes of three-word shingles are two bits apart or fewer."""
    return simhash.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of ``benchmark``."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for every copy the mix takes."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in random order, with size, shard and slot."""
    return sharding.shuffled_shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

# A trained classifier, simhashes of shingles and a random shuffle are beyond SQL.
ORACLE_SQL: str | None = None


# Each stage can run on its own.
STAGES = [(name, shipped(stage)) for name, stage in STAGES]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result written and read again.

    What a stage wrote on the way, and its predecessor's rows, are deleted once its own are written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with intermediates(spark) as passing:
            docs = hold(stage(spark, docs, sf_dir), name)
            written = passing.pop()
        if before:
            drop(spark, before)
        before = written
    return docs
