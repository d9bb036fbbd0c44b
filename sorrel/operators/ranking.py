"""Evaluation of ranked lists against gold sets, for all queries in one plan.

runs: (query_id, doc_id, rank); gold: (query_id, doc_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def filled(rows: DataFrame) -> DataFrame:
    """rows without those whose document has a null or blank id."""
    return rows.where(F.trim(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) != "")


def recall_at(runs: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """query_id, hits, recall for every query of gold. Queries without gold have no row; see evaluate()."""
    wanted = filled(gold).distinct()
    hits = runs.where(F.col("rank") <= k).select("query_id", "doc_id").distinct().withColumn("_hit", F.lit(1))
    met = wanted.join(hits, ["query_id", "doc_id"], "left")
    return met.groupBy("query_id").agg(F.count("_hit").alias("hits"), (F.count("_hit") / F.count(F.lit(1))).alias("recall"))


def average_precision(runs: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """query_id, ap: a repeated document counts once but its repeats still take a rank; divided by min(gold, k)."""
    wanted = filled(gold).distinct()
    first = runs.where(F.col("rank") <= k).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    met = first.join(wanted, ["query_id", "doc_id"], "left_semi")
    upto = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    sums = met.withColumn("precision", upto / F.col("rank")).groupBy("query_id").agg(F.sum("precision").alias("_sum"))
    sizes = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    return sizes.join(sums, "query_id", "left").select("query_id", (F.coalesce("_sum", F.lit(0.0)) / F.least("_n", F.lit(k))).alias("ap"))


def missing(runs: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    return filled(gold).distinct().join(runs.where(F.col("rank") <= k), ["query_id", "doc_id"], "left_anti")


def ranked_ids(runs: DataFrame, k: int) -> DataFrame:
    """query_id, ids: the first k documents of each query, in order."""
    top = filled(runs).where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("_found"))
    return top.select("query_id", F.transform("_found", lambda x: x["doc_id"].cast("string")).alias("ids"))


def stage_summary(stages: dict[str, tuple[DataFrame, int]], gold: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """query_id, and for each named stage of (runs, k) its ids, hits, recall and ap. Queries without gold or hits have zeros and no ids."""
    out = (gold if queries is None else queries).select("query_id").distinct()
    for name, (runs, k) in stages.items():
        scored = recall_at(runs, gold, k).join(average_precision(runs, gold, k), "query_id")
        out = out.join(scored.select("query_id", *[F.col(c).alias(f"{name}_{c}") for c in ("hits", "recall", "ap")]), "query_id", "left")
        out = out.join(ranked_ids(runs, k).withColumnRenamed("ids", f"{name}_ids"), "query_id", "left")
    zeros = {f"{n}_{c}": 0 for n in stages for c in ("hits", "recall", "ap")}
    return out.na.fill(zeros).withColumns({f"{n}_ids": F.coalesce(f"{n}_ids", F.array().cast("array<string>")) for n in stages})


def macro_means(summary: DataFrame) -> DataFrame:
    """One row: query_count, map_at_k, and the mean recall of each stage of stage_summary(); zeros without queries."""
    stages = [c.removesuffix("_recall") for c in summary.columns if c.endswith("_recall")]
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return summary.agg(F.count(F.lit(1)).alias("query_count"), *([mean("final_ap").alias("map_at_k")] if "final" in stages else []), *[mean(f"{s}_recall").alias(f"mean_{s}_recall") for s in stages])


def by_category(per_query: DataFrame) -> DataFrame:
    """category, queries, map, recall from (query_id, category, ap, recall)."""
    return per_query.groupBy("category").agg(F.count(F.lit(1)).alias("queries"), F.avg("ap").alias("map"), F.avg("recall").alias("recall"))


def evaluate(queries: DataFrame, runs: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """query_id, category, hits, recall, ap for every query; 0 where gold is empty."""
    scored = recall_at(runs, gold, k).join(average_precision(runs, gold, k), "query_id")
    return queries.select("query_id", "category").join(scored, "query_id", "left").na.fill(0)
