"""The corpus pipeline: five stages over documents, each written as Parquet and reread by the next.

Quality rules drop documents judged bad; the n-gram Jaccard join keeps one document of each near-duplicate class;
decontamination drops documents that hold a benchmark window; mixing repeats or leaves out documents to meet the sources'
weights; sharding gives every copy its shard.

No stage reads a column but doc_id, source and text, and whatever columns documents have pass through unchanged. Null texts
count as empty and go in the first stage, rows that repeat count each until the second, null ids and sources are kept, ties
are settled by ids and hashes, and an empty table gives no rows; the operators' docstrings tell each case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sorrel.llm import decontamination, mixing, near_duplicates, quality_rules, sharding
from sorrel.llm.common import forget, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep. Null and very short texts go."""
    return quality_rules.keep_good(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document with the least doc_id."""
    return near_duplicates.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a window of the benchmark."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in order of virtual finish time."""
    return mixing.mix(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies with size and shard; copies of a text share a shard."""
    return sharding.assign_shards(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("sharding", assign_shards),
]

#: Expectation-maximisation and MinHash can't be put in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{k}")
        forget(before)
    return docs
