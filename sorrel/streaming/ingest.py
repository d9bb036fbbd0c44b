"""Resumable ingestion: micro-batches of raw reviews into a document table, with dead letters.

Each batch is written under its own batch_id partition, so a batch that runs again overwrites itself. Reviews whose id is in
the table are skipped before any cleaning; then rows with errors are set aside, those with a known content dropped, and within
the batch the greedy dedupe holds in order of arrival. What is known is asked of the stored keys (see keys), never of the
stored documents. Enrichment and indexing are optional slots. Documents and dead letters
(stages preprocess, llm_enrich, index) are separate outputs of one idempotent step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sorrel.functions import arrays, text
from sorrel.operators import documents as docs_ops
from sorrel.operators import lexical
from sorrel.scratch import forget, written
from sorrel.sources import files
from sorrel.streaming import keys

#: Fields of the plain index.
INDEXED = ("content", "title", "product_name", "item_name")
DEAD_LETTERS = "stage string, review_id string, error string, batch_id int"


def stored(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The table's rows of batches before the given one; None where nothing was written yet."""
    if not files.any_path(spark, f"{folder}/batch_id=*"):
        return None
    rows = spark.read.option("basePath", folder).parquet(folder)
    return rows if before is None else rows.where(F.col("batch_id") < before)


def raw_id(rows: DataFrame) -> Column:
    """The id of raw reviews, from whichever of its two names they have."""
    named = [F.col(c).cast("string") for c in ("reviewId", "review_id") if c in rows.columns]
    return text.strip(F.coalesce(arrays.first_filled(*named), F.lit(""))) if named else F.lit("")


@dataclass(frozen=True)
class Steps:
    """What a batch goes through. prepare(rows, keep): documents with an error column, and keep as kept_column. enrich: documents
    again, with an error column for those that failed. index: (review_id, error) of documents that could not be indexed."""

    prepare: Callable[[DataFrame, Column], DataFrame] = docs_ops.to_documents
    enrich: Callable[[DataFrame], DataFrame] | None = None
    index: Callable[[DataFrame, int], DataFrame] | None = None


def ingest_batch(batch: DataFrame, batch_id: int, folder: str, failures: str, steps: Steps | None = None) -> dict[str, int]:
    """One micro-batch. Returns counts of its rows: processed, resumed (skipped by id), failed, kept, indexed.

    A document whose enrichment fails is left out; copies of it in the same batch count as seen and come again with the
    next one.
    """
    steps, spark = steps or Steps(), batch.sparkSession
    seen, fresh = Observation(f"seen-{batch_id}"), Observation(f"fresh-{batch_id}")
    placed = batch.withColumns({"_place": F.monotonically_increasing_id(), "_id_key": keys.id_key(raw_id(batch))})
    known = keys.known(spark, folder, placed.select(F.col("_id_key").alias("key")), batch_id)
    rows = keys.without(placed.observe(seen, F.count(F.lit(1)).alias("n")), "_id_key", known)
    rows = rows.observe(fresh, F.count(F.lit(1)).alias("n")).drop("_id_key")
    ready = written(steps.prepare(rows, F.col("_place")), "ingest-ready")
    letter = lambda stage, failed: failed.select(F.lit(stage).alias("stage"), F.col("review_id").cast("string").alias("review_id"), "error", F.lit(batch_id).alias("batch_id"))
    letters = letter("preprocess", ready.where("error IS NOT NULL"))
    good = written(ready.where("error IS NULL").drop("error").withColumn("_print", text.fingerprint_any(F.col("content"))), "ingest-good")
    checked = good.withColumns({"_id_key": keys.id_key(F.col("review_id")), "_print_key": keys.print_key(F.col("_print"))})
    known = keys.known(spark, folder, checked.select(F.explode(F.array("_id_key", "_print_key")).alias("key")), batch_id)
    new = keys.without(keys.without(checked, "_id_key", known), "_print_key", known).drop("_id_key", "_print_key")
    kept = docs_ops.dedupe_greedy(new, "review_id", "_print", "kept_column").drop("_print", "kept_column")
    if steps.enrich is not None:
        enriched = written(steps.enrich(kept), "ingest-enriched")
        letters = letters.unionByName(letter("llm_enrich", enriched.where("error IS NOT NULL")))
        kept = enriched.where("error IS NULL").drop("error")
    overwrite = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id")
    counted = Observation(f"kept-{batch_id}")
    overwrite(kept.observe(counted, F.count(F.lit(1)).alias("n")).withColumn("batch_id", F.lit(batch_id))).parquet(folder)
    n_kept, indexed = counted.get["n"], 0
    table = spark.read.option("basePath", folder).schema(kept.schema).parquet(f"{folder}/batch_id={batch_id}") if n_kept else kept.limit(0)
    keys.store(table, folder, batch_id, text.fingerprint_any(F.col("content")))
    if steps.index is not None:
        failed = written(steps.index(table, batch_id) if n_kept else spark.createDataFrame([], "review_id string, error string"), "ingest-index")
        letters = letters.unionByName(letter("index", failed))
        indexed = n_kept - failed.count()
    letters = written(letters, "ingest-letters")
    overwrite(letters).json(failures)
    n_failed = letters.where("stage <> 'index'").count()
    forget(ready, good, letters)
    return {"processed": seen.get["n"], "resumed": seen.get["n"] - fresh.get["n"], "failed": n_failed, "kept": n_kept, "indexed": indexed}


def index_keys(spark: SparkSession, folder: str) -> None:
    """Write the keys of a document table that has none, batch by batch: for tables that another program wrote."""
    rows = stored(spark, folder)
    for r in rows.select("batch_id").distinct().collect() if rows is not None else []:
        keys.store(rows.where(F.col("batch_id") == r["batch_id"]), folder, r["batch_id"], text.fingerprint_any(F.col("content")))


def dead_letters(spark: SparkSession, failures: str) -> DataFrame:
    """The failures of all batches; none where none was written yet."""
    if not files.any_path(spark, f"{failures}/batch_id=*"):
        return spark.createDataFrame([], DEAD_LETTERS)
    return spark.read.schema(DEAD_LETTERS).option("basePath", failures).json(failures)


def ingest_stream(source: DataFrame, folder: str, failures: str, checkpoint: str, steps: Steps | None = None):
    """A query that takes what is there and stops; started again with the same checkpoint it takes only what is new."""
    writer = source.writeStream.foreachBatch(lambda batch, batch_id: ingest_batch(batch, batch_id, folder, failures, steps) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def in_batches(rows: DataFrame, size: int) -> list[DataFrame]:
    """rows in batches of size, in the order of reading."""
    placed = written(files.numbered(rows), "ingest-input")
    return [placed.where(F.col("ordinal").between(low + 1, low + size)).orderBy("ordinal").drop("ordinal") for low in range(0, placed.count(), size)]


def index_documents(documents: DataFrame, index_folder: str, fields: tuple[str, ...] = INDEXED) -> None:
    """Build and store the lexical index of a table of documents."""
    lexical.store_index(lexical.build_index(documents, "review_id", lexical.standard_fields(list(fields))), index_folder)


def reindex(spark: SparkSession, folder: str, index_folder: str, fields: tuple[str, ...] = INDEXED) -> lexical.Index:
    """The index of all documents of the table, from what was written and not from the raw reviews. What is written is visible to the next reader."""
    index_documents(stored(spark, folder), index_folder, fields)
    return lexical.load_index(spark, index_folder)


def index_count(spark: SparkSession, folder: str) -> int:
    rows = stored(spark, folder)
    return 0 if rows is None else rows.count()
