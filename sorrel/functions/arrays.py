"""Array, nested and numeric helpers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sorrel.functions.text import strip, truncated
from sorrel.vocab import ISSUE_CATEGORIES, OTHER, SENTIMENTS

METADATA_SCHEMA = "issue_category array<string>, aspect_keywords array<string>, issue_sentiments array<struct<issue_category:string,sentiment:string,evidence:string>>, short_summary string"


def value_or(c: Column, default) -> Column:
    """default for null and for NaN, as a number or as text."""
    return F.when(c.isNull() | (F.lower(c.cast("string")) == "nan"), F.lit(default)).otherwise(c)


def first_filled(*options: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options])


def listed(c: Column) -> Column:
    """A text that may be a JSON list as an array: its items, or the text alone; none for null, empty and a list that can't be read."""
    whole = strip(F.coalesce(c, F.lit("")))
    items = F.filter(F.coalesce(F.from_json(whole, "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull())
    return F.when(F.startswith(whole, F.lit("[")), items).when(whole == "", F.array().cast("array<string>")).otherwise(F.array(whole))


def not_empty(c: Column) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def padded(items: Column, length: int, filler: str) -> Column:
    return F.slice(F.concat(F.slice(items, 1, length), F.array_repeat(F.lit(filler), length)), 1, length)


def known_categories(items: Column) -> Column:
    """The first three different known categories, filled up to three."""
    named = F.filter(F.transform(items, strip), lambda c: c.isin(ISSUE_CATEGORIES))
    return padded(F.array_distinct(named), 3, OTHER)


def keywords(items: Column) -> Column:
    """The first five keywords that aren't blank, repeated ones too, filled up to five."""
    return padded(F.filter(F.transform(items, strip), lambda k: k != ""), 5, OTHER)


def valid_sentiments(items: Column, categories: Column) -> Column:
    """The first three items, repaired: unknown category to the first category, unknown sentiment to neutral."""
    text = lambda c: F.coalesce(strip(c), F.lit(""))
    return F.transform(
        F.slice(items, 1, 3),
        lambda s: F.struct(
            F.when(text(s["issue_category"]).isin(ISSUE_CATEGORIES), text(s["issue_category"])).otherwise(F.element_at(categories, 1)).alias("issue_category"),
            F.when(F.lower(text(s["sentiment"])).isin(SENTIMENTS), F.lower(text(s["sentiment"]))).otherwise("neutral").alias("sentiment"),
            truncated(text(s["evidence"]), 120).alias("evidence"),
        ),
    )


def normalized_metadata(m: Column) -> Column:
    """A model's metadata struct, made to fit its rules."""
    empty = lambda c: F.coalesce(c, F.array())
    categories = known_categories(empty(m["issue_category"]))
    sentiments = F.coalesce(m["issue_sentiments"], F.from_json(F.lit("[]"), "array<struct<issue_category:string,sentiment:string,evidence:string>>"))
    return F.struct(
        categories.alias("issue_category"),
        keywords(empty(m["aspect_keywords"])).alias("aspect_keywords"),
        valid_sentiments(sentiments, categories).alias("issue_sentiments"),
        truncated(F.coalesce(strip(m["short_summary"]), F.lit("")), 80).alias("short_summary"),
    )


def empty_metadata() -> Column:
    """What stands for a failed enrichment: one category, not filled up."""
    return F.from_json(F.lit(f'{{"issue_category":["{OTHER}"],"aspect_keywords":[],"issue_sentiments":[],"short_summary":""}}'), METADATA_SCHEMA)


def parsed_metadata(c: Column) -> Column:
    """Metadata from a model's JSON answer; what can't be parsed gives the empty metadata."""
    parsed = F.from_json(c, METADATA_SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return F.when(c.isNotNull() & parsed["_bad"].isNull(), normalized_metadata(parsed)).otherwise(empty_metadata())


def has_issue(items: Column, category: str, sentiment: str) -> Column:
    """True if one and the same element has both."""
    return F.coalesce(F.exists(items, lambda s: (s["issue_category"] == category) & (s["sentiment"] == sentiment)), F.lit(False))


def first_argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def weights_to_one(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.transform(values, lambda x: F.when(total > 0, x / total).otherwise(F.raise_error(F.lit("weights must sum to more than 0")).cast("double")))


def softmax(values: Column) -> Column:
    powers = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def review_time(c: Column) -> Column:
    """ISO text or epoch milliseconds; anything else is null."""
    return F.coalesce(F.timestamp_millis(c.try_cast("bigint")), F.try_to_timestamp(c))


def holdout_size(n: Column, share: float) -> Column:
    """Rows of a class to hold out: rounded half to even, one at least."""
    return F.greatest(F.lit(1), F.bround(n * F.lit(share)).cast("int"))


def greatest_of(columns: list[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def sum_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
