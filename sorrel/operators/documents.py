"""Raw reviews to retrieval documents: projection, filters, greedy dedupe and the resumable build."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sorrel.functions import arrays, text
from sorrel.scratch import forget, written
from sorrel.vocab import LEAST_LENGTH, LEAST_MEANINGFUL

EMPTY_ISSUES = "array<struct<issue_category:string,sentiment:string,evidence:string>>"


def to_documents(reviews: DataFrame, keep: Column | None = None) -> DataFrame:
    """Raw reviews (sources.files.REVIEW_SCHEMA) as documents, without those that lack an id, a product, content or signal.

    Numbers that aren't null or NaN must parse: try_cast leaves null, which the error column reports, in place of a crash.
    keep: a further column to pass through, such as a row's place.
    """
    c = F.col
    whole = lambda name: arrays.value_or(c(name), "0").try_cast("double").cast("int")
    answers = F.filter(F.coalesce("reviewSurveyAnswers", F.array()), lambda s: F.coalesce(s["question"], F.lit("")) != "")
    raw = reviews.select(
        text.strip(F.coalesce(arrays.first_filled(c("reviewId"), c("review_id")), F.lit(""))).alias("review_id"),
        arrays.review_time(F.coalesce(c("reviewAt"), F.lit("0"))).alias("review_at"),
        c("product_name"),
        arrays.first_filled(c("itemName"), c("item_name")).alias("item_name"),
        c("title"),
        c("content"),
        F.transform(answers, lambda s: s["question"]).alias("questions"),
        F.transform(answers, lambda s: s["answer"]).alias("answers"),
        *[whole(a).alias(b) for a, b in (("rating", "rating"), ("helpfulCount", "helpful_count"), ("helpfulTrueCount", "helpful_true_count"), ("helpfulFalseCount", "helpful_false_count"))],
        arrays.not_empty(c("attachments")).alias("has_image"),
        arrays.not_empty(c("videoAttachments")).alias("has_video"),
        arrays.first_filled(c("summary"), c("short_summary")).alias("short_summary"),
        F.coalesce(arrays.first_filled(F.array_join(arrays.listed(c("aspect")), " ")), F.array_join("aspect_keywords", " ")).alias("aspect"),
        *([] if keep is None else [keep.alias("kept_column")]),
    )
    cleaned = text.clean_columns(raw, ("product_name", "item_name", "title", "content", "short_summary", "aspect"), ("answers",))
    kept = cleaned.where(usable(c("review_id"), c("product_name"), c("content")))
    shaped = kept.select(
        "review_id", "review_at", "product_name", "item_name", "title", "content",
        F.zip_with("questions", "answers", lambda q, a: F.struct(q.alias("question"), a.alias("answer"))).alias("review_survey_answers"),
        "rating", "helpful_count", "helpful_true_count", "helpful_false_count", "has_image", "has_video",
        F.nullif(c("short_summary"), F.lit("")).alias("short_summary"), F.when(c("aspect") != "", F.array("aspect")).alias("aspect_keywords"),
        *([] if keep is None else ["kept_column"]),
    )
    columns = {n: c(n) for n in shaped.columns} | {"issue_category": F.lit(None).cast("array<string>"), "issue_sentiments": F.lit(None).cast(EMPTY_ISSUES)}
    return shaped.withColumn("dense_text", text.dense_text(columns)).withColumn("error", F.when(c("rating").isNull(), "rating is not a number"))


def usable(review_id: Column, product: Column, content: Column) -> Column:
    filled = (F.coalesce(review_id, F.lit("")) != "") & (F.coalesce(product, F.lit("")) != "") & (F.coalesce(content, F.lit("")) != "")
    return filled & text.has_signal(content, LEAST_LENGTH, LEAST_MEANINGFUL)


def dedupe_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key: exact where ids are unique. One shuffle on the key, cut early by WindowGroupLimit."""
    ranked = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_nth = 1").drop("_nth")


def dedupe_greedy(rows: DataFrame, first_key: str, second_key: str, position: str) -> DataFrame:
    """Rows kept by going through them in order of position (unique) and dropping any that shares a key with a row kept before.

    Rounds in parallel: keep undecided rows that come first under both of their keys, then drop those sharing a key with
    a kept row. Rounds move keys and positions only, find first rows by aggregates that combine before the shuffle, and
    are written; at least the first undecided row is decided in each. A null key is like no other.
    """
    rows = written(rows, "dedupe-rows")
    place = F.col(position)
    keyed = lambda key: F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.concat(F.lit("-"), place.cast("string")))
    undecided, kept = written(rows.select(keyed(first_key).alias("a"), keyed(second_key).alias("b"), place.alias("place")), "dedupe-keys"), []
    while undecided.take(1):
        by_a = undecided.groupBy("a").agg(F.min(F.struct("place", "b")).alias("first")).select("a", "first.b", "first.place")
        by_b = undecided.groupBy("b").agg(F.min("place").alias("place"))
        new = written(by_a.join(by_b, ["b", "place"]), "dedupe-new")
        rest = undecided.join(new.select("a"), "a", "left_anti").join(new.select("b"), "b", "left_anti").select("a", "b", "place")
        before, undecided = undecided, written(rest, "dedupe-keys")
        forget(before)
        kept.append(new.select("place"))
    if not kept:
        return rows
    return rows.join(reduce(DataFrame.unionByName, kept).withColumnRenamed("place", position), position, "left_semi").select(*rows.columns)


def build_documents(reviews: DataFrame, order: str | None = None) -> DataFrame:
    """Documents of reviews, in order of the named column (else as they are read): of those that share an id or a content
    with one kept before, none is kept."""
    place = F.monotonically_increasing_id() if order is None else F.col(order)
    keyed = to_documents(reviews, place).withColumn("_print", text.fingerprint(F.col("content")))
    return dedupe_greedy(keyed, "review_id", "_print", "kept_column").drop("_print", "kept_column")


def without_known(rows: DataFrame, known: DataFrame, id_column: str, content: str) -> DataFrame:
    """rows whose id and whose content are both new to known: two anti joins."""
    prints = known.select(text.fingerprint_any(F.col(content)).alias("_print")).distinct()
    fresh = rows.join(known.select(id_column).distinct(), id_column, "left_anti").withColumn("_print", text.fingerprint_any(F.col(content)))
    return fresh.join(prints, "_print", "left_anti").drop("_print")
