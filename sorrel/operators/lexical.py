"""Inverted index as tables, and BM25 clauses over it.

postings: (field, term, doc_id, tf, dl); places: (field, term, doc_id, place, dl). A clause is a set of weighted query terms;
scoring joins them with postings and sums, so every query of a batch is answered by one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.functions import text
from sorrel.vocab import BM25_B, BM25_K1


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    fields: DataFrame
    terms: DataFrame
    places: DataFrame


def occurrences(docs: DataFrame, id_column: str, fields: dict[str, Column]) -> DataFrame:
    """(field, doc_id, dl, place, term) for every token of the named token-array columns."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), t.alias("tokens")) for n, t in fields.items()])).alias("f")
    flat = docs.select(F.col(id_column).alias("doc_id"), each).select("doc_id", "f.field", "f.tokens", F.size("f.tokens").cast("long").alias("dl"))
    return flat.select("field", "doc_id", "dl", F.posexplode("tokens").alias("place", "term"))


def build_index(docs: DataFrame, id_column: str, fields: dict[str, Column], only: DataFrame | None = None) -> Index:
    """The index of docs: N and mean length by field, document frequency by term. Fields without a token don't count for N.

    only: a table of term, to index nothing but the terms that will be asked for. Lengths and N still cover all tokens.
    """
    places = occurrences(docs, id_column, fields)
    if only is not None:
        places = places.join(only.select("term").distinct(), "term", "left_semi").select("field", "doc_id", "dl", "place", "term")
    postings = places.groupBy("field", "term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    lengths = [F.struct(F.lit(n).alias("field"), F.size(t).cast("long").alias("dl")) for n, t in fields.items()]
    sizes = docs.select(F.explode(F.array(*lengths)).alias("f")).select("f.*").where("dl > 0")
    stats = sizes.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return Index(postings, stats, postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")), places.select("field", "term", "doc_id", "place", "dl"))


def store_index(index: Index, folder: str, files: int | None = None) -> None:
    """Write the index as tables ordered by term and document, so that a query's terms prune row groups on reading and a frequent term has many files.

    files: how many; by default as many as the bytes take.
    """
    for name in ("postings", "terms", "places"):
        rows = getattr(index, name)
        order = [c for c in ("term", "field", "doc_id") if c in rows.columns]
        dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
        dealt.sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{folder}/{name}")
    index.fields.coalesce(1).write.mode("overwrite").parquet(f"{folder}/fields")


def load_index(spark: SparkSession, folder: str) -> Index:
    return Index(*[spark.read.parquet(f"{folder}/{name}") for name in ("postings", "fields", "terms", "places")])


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(n: Column, df: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    return idf(n, df) * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / avgdl))


def query_terms(queries: DataFrame, tokens: Column, fields: dict[str, float], boost: float = 1.0) -> DataFrame:
    """(query_id, field, term, weight): each token of each query once for each field; a repeated token weighs more."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(float(w * boost)).alias("w")) for f, w in fields.items()])).alias("f")
    exploded = queries.select("query_id", F.explode(tokens).alias("term")).select("query_id", "term", each)
    return exploded.groupBy("query_id", F.col("f.field").alias("field"), "term").agg(F.sum("f.w").alias("weight"))


def score_fields(index: Index, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, field, score): BM25 of a clause in each field."""
    weighed = terms.join(index.terms, ["field", "term"]).join(F.broadcast(index.fields), "field")
    met = index.postings.join(weighed, ["field", "term"])
    gain = F.col("weight") * bm25(F.col("n"), F.col("df"), F.col("tf"), F.col("dl"), F.col("avgdl"))
    return met.groupBy("query_id", "doc_id", "field").agg(F.sum(gain).alias("score"))


def best_fields(scored: DataFrame) -> DataFrame:
    return scored.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def most_fields(scored: DataFrame) -> DataFrame:
    return scored.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def match(index: Index, queries: DataFrame, tokens: Column, fields: dict[str, float], boost: float = 1.0, mode: str = "best") -> DataFrame:
    scored = score_fields(index, query_terms(queries, tokens, fields, boost))
    return best_fields(scored) if mode == "best" else most_fields(scored)


def phrase(index: Index, queries: DataFrame, tokens: Column, fields: dict[str, float], boost: float = 1.0) -> DataFrame:
    """Documents where all of a query's tokens stand in a row. Scored as one term whose idf is the sum of its words' idfs.

    A phrase is looked up by its rarest word; only where that stands are the other words' places looked up.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(float(w * boost)).alias("weight")) for f, w in fields.items()])).alias("f")
    words = queries.select("query_id", F.posexplode(tokens).alias("offset", "term"), F.size(tokens).alias("length"))
    words = words.select("query_id", "offset", "term", "length", each).select("query_id", "offset", "term", "length", "f.field", "f.weight")
    known = words.join(index.terms, ["field", "term"]).join(F.broadcast(index.fields), "field")
    word = F.struct("df", "offset", "term")
    whole = known.groupBy("query_id", "field", "weight", "length").agg(F.collect_list(word).alias("words"), F.min(word).alias("rarest"), F.sum(idf(F.col("n"), F.col("df"))).alias("idf"), F.first("avgdl").alias("avgdl"))
    whole = whole.where(F.size("words") == F.col("length")).select("query_id", "field", "weight", "length", "words", "idf", "avgdl", "rarest.offset", "rarest.term")
    starts = index.places.join(whole, ["field", "term"]).withColumn("start", F.col("place") - F.col("offset")).drop("place", "term")
    others = F.explode_outer(F.filter("words", lambda w: w["offset"] != F.col("offset"))).alias("other")
    wanted = starts.select("query_id", "field", "weight", "length", "idf", "avgdl", "doc_id", "dl", "start", others)
    wanted = wanted.select("*", F.col("other.term").alias("term"), (F.col("start") + F.col("other.offset")).alias("place")).drop("other")
    met = wanted.join(index.places.select("field", "term", "doc_id", "place", F.lit(1).alias("there")), ["field", "term", "doc_id", "place"], "left")
    hits = met.groupBy("query_id", "field", "weight", "length", "idf", "avgdl", "doc_id", "dl", "start").agg(F.count("there").alias("found")).where(F.col("found") == F.col("length") - 1)
    scored = hits.groupBy("query_id", "field", "weight", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.first("idf").alias("idf"), F.first("avgdl").alias("avgdl"), F.first("dl").alias("dl"))
    gain = F.col("weight") * F.col("idf") * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl")))
    return best_fields(scored.select("query_id", "doc_id", "field", gain.alias("score")))


def keyword_term(docs: DataFrame, id_column: str, values: Column, queries: DataFrame, value: str, boost: float = 1.0) -> DataFrame:
    """Documents whose keyword field (an array) holds the query's value: idf times boost, without length."""
    each = docs.select(F.col(id_column).alias("doc_id"), F.explode(F.array_distinct(values)).alias("key"))
    total = docs.where(F.size(values) > 0).agg(F.count(F.lit(1)).alias("n"))
    df = each.groupBy("key").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(total))
    wanted = queries.select("query_id", F.col(value).alias("key")).join(df, "key")
    score = F.lit(boost) * idf(F.col("n"), F.col("df")) * (BM25_K1 + 1) / (1 + BM25_K1)
    return each.join(wanted, "key").select("query_id", "doc_id", score.alias("score"))


def nested_match(elements: DataFrame, parent: str, queries: DataFrame, element_tokens: Column, tokens: Column, boost: float = 1.0, score_mode: str = "max") -> DataFrame:
    """BM25 of each element by itself; a parent has the score of its best element (max), its elements' sum or mean (sum, avg), or 0 (none)."""
    numbered = elements.withColumn("_element", F.struct(parent, F.monotonically_increasing_id())) if "_element" not in elements.columns else elements
    index = build_index(numbered, "_element", {"element": element_tokens})
    scored = match(index, queries, tokens, {"element": 1.0}, boost)
    modes = {"max": F.max("score"), "sum": F.sum("score"), "avg": F.avg("score"), "none": F.max(F.lit(0.0))}
    return scored.groupBy("query_id", F.col("doc_id").getField(parent).alias("doc_id")).agg(modes[score_mode].alias("score"))


def wildcard(docs: DataFrame, id_column: str, value: Column, pattern: str, boost: float = 1.0) -> DataFrame:
    """Documents whose value fits a pattern with * and ?: a constant score."""
    import re

    fits = value.rlike("(?s)^" + "".join(".*" if p == "*" else "." if p == "?" else re.escape(p) for p in re.split(r"([*?])", pattern)) + "$")
    return docs.where(fits).select(F.col(id_column).alias("doc_id"), F.lit(float(boost)).alias("score"))


def any_of(clauses: list[DataFrame]) -> DataFrame:
    """A bool of should clauses, one of which must match: their scores add up."""
    out = clauses[0].select("query_id", "doc_id", "score")
    for c in clauses[1:]:
        out = out.unionByName(c.select("query_id", "doc_id", "score"))
    return out.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def standard_fields(names: list[str]) -> dict[str, Column]:
    """Token arrays of text columns, for build_index; an array column counts all its values as one field."""
    return {n: text.tokens(F.coalesce(F.col(n), F.lit(""))) for n in names}
