"""Wildcard search by an index of trigrams.

Every stored value is filed under its different trigrams. The literal parts of a pattern must stand in a fitting value, so the
value is among those of all their trigrams: their postings are intersected first, and the pattern runs on what is left. A
pattern without a literal of three characters is run on all values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.scratch import scratch_path, ship

SIZE = 3


@dataclass(frozen=True)
class Substrings:
    """postings (field, gram, doc_id), ordered by field and gram; values (field, doc_id, value)."""

    postings: DataFrame
    values: DataFrame


def trigrams(value: Column) -> Column:
    """The different trigrams of a text, in order; none of a shorter one. In Arrow batches: places in UTF-8 are found by going through the text."""

    def run(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in values:
            yield pa.array([sorted({v[k : k + SIZE] for k in range(len(v) - SIZE + 1)}) if v is not None else [] for v in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(value)


def build(documents: DataFrame, id_column: str, fields: dict[str, Column], folder: str | None = None) -> Substrings:
    """The index of the named text columns, stored in folder (scratch without one). Null values are left out."""
    spark = documents.sparkSession
    folder = folder or scratch_path(spark, "substrings")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in fields.items()])).alias("f")
    values = documents.select(F.col(id_column).alias("doc_id"), each).select("f.field", "doc_id", "f.value").where("value IS NOT NULL")
    values.write.mode("overwrite").parquet(f"{folder}/values")
    stored = spark.read.parquet(f"{folder}/values")
    filed = stored.select("field", "doc_id", F.explode(trigrams(F.col("value"))).alias("gram"))
    filed.repartitionByRange("field", "gram", "doc_id").sortWithinPartitions("field", "gram", "doc_id").select("field", "gram", "doc_id").write.mode("overwrite").parquet(f"{folder}/postings")
    return load(spark, folder)


def load(spark: SparkSession, folder: str) -> Substrings:
    return Substrings(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/values"))


def required(pattern: str) -> list[str]:
    """The trigrams of a pattern's literal parts; * and ? are wild."""
    return sorted({part[k : k + SIZE] for part in re.split(r"[*?]", pattern) for k in range(len(part) - SIZE + 1)})


def expression(pattern: str) -> str:
    return "(?s)^" + "".join(".*" if p == "*" else "." if p == "?" else re.escape(p) for p in re.split(r"([*?])", pattern)) + "$"


def candidates(index: Substrings, field: str, pattern: str) -> DataFrame:
    """(doc_id, value) of the field's values that hold all trigrams that the pattern needs."""
    values, wanted = index.values.where(F.col("field") == field).select("doc_id", "value"), required(pattern)
    if not wanted:
        return values
    # A document may hold a field once only, so each gram counts once.
    found = index.postings.where((F.col("field") == field) & F.col("gram").isin(wanted)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted))
    return values.join(found.select("doc_id"), "doc_id")


def wildcard(index: Substrings, field: str, pattern: str, boost: float = 1.0) -> DataFrame:
    """(doc_id, score): documents whose value fits a pattern with * and ?, at a constant score. The same as lexical.wildcard, over candidates()."""
    return candidates(index, field, pattern).where(F.col("value").rlike(expression(pattern))).select("doc_id", F.lit(float(boost)).alias("score"))


ship(__name__)
