"""Document enrichment: a slot for a language model and a rule-based default."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sorrel import vocab
from sorrel.functions import arrays, terms, text
from sorrel.scratch import ship


def told_metadata(value: str | None, found: set[str]) -> dict:
    """Raw metadata of a text that holds the found terms: its aspects, their terms, and issues with the sentiment of the aspect's own terms and the first term as evidence."""
    issues = []
    for aspect, terms in vocab.ASPECT_TERMS.items():
        if evidence := next((t for t in terms if t in found), None):
            good, bad = (any(t in found for t in table[aspect]) for table in (vocab.POSITIVE_TERMS, vocab.NEGATIVE_TERMS))
            issues.append({"issue_category": aspect, "sentiment": "mixed" if good and bad else "positive" if good else "negative" if bad else "neutral", "evidence": evidence})
    return {"issue_category": [i["issue_category"] for i in issues], "aspect_keywords": [t for ts in vocab.ASPECT_TERMS.values() for t in ts if t in found], "issue_sentiments": issues, "short_summary": (value or "")[:80]}


def rule_metadata(content: Column) -> Column:
    """Raw metadata from the aspect vocabularies, see told_metadata(); all terms are looked for in one pass over the text."""
    tables = (vocab.ASPECT_TERMS, vocab.POSITIVE_TERMS, vocab.NEGATIVE_TERMS)
    return terms.by_terms([t for table in tables for ts in table.values() for t in ts], told_metadata, arrays.METADATA_SCHEMA)(content)


def enrich(documents: DataFrame, answers: Column | None = None) -> DataFrame:
    """documents with metadata (from a model's JSON answers, or by rule) and dense_text anew."""
    if answers is None:
        with_meta = documents.withColumn("_raw", rule_metadata(F.col("content"))).withColumn("_meta", arrays.normalized_metadata(F.col("_raw"))).drop("_raw")
    else:
        with_meta = documents.withColumn("_meta", arrays.parsed_metadata(answers))
    for name in ("issue_category", "aspect_keywords", "issue_sentiments", "short_summary"):
        with_meta = with_meta.withColumn(name, F.col(f"_meta.{name}"))
    named = {n: F.col(n) for n in with_meta.columns}
    return with_meta.drop("_meta").withColumn("dense_text", text.dense_text(named))


def model_answers(documents: DataFrame, ask: Callable[[pd.DataFrame], pd.Series], schema: str = "review_id string, answer string, error string") -> DataFrame:
    """The slot for a language model: ask gets a batch of documents and returns JSON texts. A failing batch gives errors, not a crash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame({"review_id": batch["review_id"], "answer": None, "error": None}, dtype=object)
            try:
                out["answer"] = list(ask(batch))
            except Exception as e:  # noqa: BLE001  reported in the rows
                out["error"] = repr(e)
            yield out

    return documents.mapInPandas(run, schema)


def prompt(d: dict[str, Column]) -> Column:
    """What a model is asked about a document."""
    rules = (
        f"Describe this smartphone review as JSON. issue_category: three of {', '.join(vocab.ISSUE_CATEGORIES)}, most important first. aspect_keywords: five short phrases. "
        f"issue_sentiments: one to three of issue_category, sentiment ({', '.join(vocab.SENTIMENTS)}) and evidence from the text. short_summary: a sentence of at most 80 characters."
    )
    fields = [F.concat(F.lit(f"{n}: "), F.coalesce(d[n].cast("string"), F.lit(""))) for n in ("product_name", "rating", "title", "content")]
    return F.concat_ws("\n", F.lit(rules), *fields)


ship(__name__)
