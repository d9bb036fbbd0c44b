"""The functions that a review application calls, under one roof. Texts are columns and records are DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.functions.text import clean_sentiment as preprocess_content
from sorrel.operators import classify, learning, review_index
from sorrel.operators.documents import build_documents
from sorrel.operators.documents import to_documents as preprocess_record
from sorrel.operators.search import expand, search, settled
from sorrel.operators.search import search_output as postprocess_results
from sorrel.operators.search import valid_output as validate_search_output
from sorrel.sources import files

__all__ = ["build_documents", "build_search_body", "postprocess_results", "predict_sentiment", "preprocess_content", "preprocess_record", "run_sentiment_analysis", "search", "validate_search_output"]


def build_search_body(documents: DataFrame, queries: DataFrame) -> dict[str, DataFrame]:
    """The clauses of the full query for each of queries (query_id, query), by name, each as scored documents."""
    expanded = settled(expand(queries))
    return review_index.clauses(review_index.build(documents, expanded=expanded), expanded)


def predict_sentiment(rows: DataFrame, predict: Callable[[str], int]) -> DataFrame:
    """(review_id, pred) of rows with review_id and content, by a classifier of single cleaned texts."""
    return learning.predict_with(rows, predict)


def run_sentiment_analysis(spark: SparkSession, path: str, output: str, predict: Callable[[str], int]) -> float | None:
    """Predict every review of a JSON file, write the predictions, and return kappa if the file has labels."""
    rows = files.load_labelled(spark, path, "review_id string, content string, label int")
    predict_sentiment(rows, predict).write.mode("overwrite").json(output)
    said = files.read_lines_strict(spark, output, "review_id string, pred int")
    labels = rows.where(F.col("label").isNotNull()).select("review_id", "label")
    if not labels.take(1):
        return None
    return classify.align(said, labels).agg(classify.kappa()).first()[0]
