"""Column helpers that several operators use, and the scratch tables of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.scratch import forget, scratch_path, ship, written

__all__ = ["SPACES", "SPACE_RUN", "fold_held_out", "forget", "free_names", "packed", "scratch_path", "ship", "table", "word_array", "word_count", "written"]

#: The six ASCII white-space characters U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def packed(docs: DataFrame, name: str) -> Column:
    """A whole row of docs as one struct column, so that no column of docs can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name)


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to differ from every column of docs."""
    taken, found = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def word_count(text: Column) -> Column:
    """The size of word_array(text), without building it: gaps between words plus one."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_RUN))).cast("long")


def fold_held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
