"""Readers and writers: JSON documents, JSON lines (tolerant or strict), CSV, and keyed document tables."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sorrel.scratch import ship, written

#: Three made-up reviews for trying things out.
DUMMY_ROWS = [("demo-1", "sorrel_one", 2, "충전 단자가 헐거워서 케이블이 자꾸 빠져요", 1), ("demo-2", "sorrel_two", 5, "사진이 밝게 나오고 가벼워서 매일 들고 다녀요", 3), ("demo-3", "sorrel_two", 3, "포장은 무난했지만 배송이 이틀 늦었습니다", 2)]
DUMMY_SCHEMA = "review_id string, product_name string, rating int, content string, label int"
REVIEW_SCHEMA = (
    "reviewId string, review_id string, reviewAt string, product_name string, itemName string, item_name string, title string, content string, summary string, short_summary string, "
    "aspect string, aspect_keywords array<string>, rating string, reviewSurveyAnswers array<struct<question:string,answer:string>>, helpfulCount string, helpfulTrueCount string, "
    "helpfulFalseCount string, attachments array<string>, videoAttachments array<string>"
)
EVALUATION_SCHEMA = "map<string,struct<query:string,category:string,reviews_to_evaluate:array<struct<reviewId:string,review_id:string>>>>"


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that is one JSON array or object."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as a folder of JSON lines, written by all tasks; null fields are kept, and letters of any script as they are."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _enclosed(lines: DataFrame, first: str, last: str, path: str) -> None:
    """The one text column of lines as a folder of files, a document from each task: first, the lines with commas between, last."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = first
        for batch in batches:
            out = []
            for line in batch.column(0).to_pylist():
                out.append(ahead + line)
                ahead = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array([last if ahead == "," else first + last], pa.string())], ["value"])

    lines.mapInArrow(run, "value string").write.mode("overwrite").text(path)


def write_array(df: DataFrame, path: str) -> None:
    """Rows as JSON arrays with a line for each row: a folder with an array from each task, which read_json reads as one table. Null fields are kept."""
    _enclosed(df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})), "[", "]", path)


def write_object(df: DataFrame, key: str, value: str, path: str) -> None:
    """Rows as JSON objects from the text column key to the column value: a folder with an object from each task."""
    name = F.to_json(F.array(F.col(key)))
    _enclosed(df.select(F.concat(F.substring(name, F.lit(2), F.length(name) - 2), F.lit(": "), F.to_json(value))), "{", "}", path)


def write_document(spark: SparkSession, value, path: str) -> None:
    """One JSON document, indented, letters of any script as they are; missing folders are made. For summaries and settings."""
    put_text(spark, json.dumps(value, ensure_ascii=False, indent=2), path)


def put_text(spark: SparkSession, body: str, path: str) -> None:
    """A small text as one file of any store that Spark writes to."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        stream.write(bytearray(body.encode()))
    finally:
        stream.close()


def timestamped(folder: str, prefix: str, now: datetime | None = None) -> str:
    return f"{folder}/{prefix}_{(now or datetime.now(timezone.utc)):%Y%m%d_%H%M%S_%f}.json"


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without those that can't be parsed."""
    read = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return read.where(F.col("_bad").isNull()).drop("_bad")


def read_lines_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def required(df: DataFrame, *names: str) -> DataFrame:
    """df, in which a row that lacks one of the named values raises."""
    checked = {n: F.when(F.col(n).isNull(), F.raise_error(F.lit(f"a row has no {n}")).cast(df.schema[n].dataType)).otherwise(F.col(n)) for n in names}
    return df.withColumns(checked)


def load_labelled(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Labelled reviews; a row without review_id raises."""
    return required(read_json(spark, path, schema), "review_id")


def load_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, category, gold ids) of an evaluation set keyed by query id."""
    text = spark.read.text(path, wholetext=True)
    entry = F.explode(F.from_json("value", EVALUATION_SCHEMA)).alias("query_id", "entry")
    gold = F.filter(F.transform("entry.reviews_to_evaluate", lambda r: F.coalesce(F.nullif(r["reviewId"], F.lit("")), r["review_id"])), lambda i: i.isNotNull() & (i != ""))
    return text.select(entry).select("query_id", "entry.query", "entry.category", gold.alias("gold"))


def write_csv(df: DataFrame, path: str) -> None:
    """Rows as a folder of CSV files, each with a header in the order of df's columns."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def first_rows(df: DataFrame, n: int | None) -> DataFrame:
    """The first n rows as they are read; all without a number."""
    return df if n is None else df.withColumn("_at", F.monotonically_increasing_id()).orderBy("_at").limit(n).drop("_at")


def numbered(df: DataFrame) -> DataFrame:
    """df, written, with ordinal, from 1 in the order of reading: counts of partitions give the offsets, so no task numbers all rows."""
    placed = written(df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    return placed.withColumn("_nth", nth).join(F.broadcast(offsets), "_part").withColumn("ordinal", F.col("_nth") + F.col("_ahead")).drop("_part", "_at", "_nth", "_ahead")


def dummy_reviews(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DUMMY_ROWS, DUMMY_SCHEMA)


def last_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes last in order."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("row")).select("row.*")


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """existing with new's rows in place of those with their keys; of new's rows with one key the last counts."""
    latest = last_of_each(new, key, order)
    return existing.join(latest.select(key), key, "left_anti").unionByName(latest.select(*existing.columns))


def first_of_each(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def any_path(spark: SparkSession, pattern: str) -> bool:
    """True if some path fits the pattern."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def create_table(spark: SparkSession, name: str, schema: str, recreate: bool = False) -> bool:
    """Make an empty table; an existing one is left alone unless it is to be made anew. True if one was made."""
    if recreate:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    elif spark.catalog.tableExists(name):
        return False
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet")
    return True


def experiment_tag(model: str, seed: int, folds: int, loss: str = "ce", weights: str = "none", gamma: float | None = None) -> str:
    """A name for a run's outputs; parts that are at their default are left out."""
    from sorrel.functions.text import float_tag

    parts = [model, *([loss] if loss != "ce" else []), *([f"g{float_tag(gamma)}"] if gamma is not None else []), *([weights] if weights != "none" else []), f"seed{seed}", f"k{folds}"]
    return "_".join(parts)


def save_predictions(df: DataFrame, folder: str, model: str, seed: int, folds: int) -> None:
    """Predictions of a run, in place of those that it wrote before; other runs' stay."""
    tagged = df.withColumns({"model": F.lit(model), "seed": F.lit(seed), "k": F.lit(folds)})
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "seed", "k").parquet(folder)


def load_predictions(spark: SparkSession, folder: str, models: list[str], seed: int, folds: int) -> DataFrame:
    """The saved predictions of the named models; a model without any raises."""
    for model in models:
        if not path_exists(spark, f"{folder}/model={model}/seed={seed}/k={folds}"):
            raise FileNotFoundError(f"no saved predictions of {model} with seed {seed} and {folds} folds")
    saved = spark.read.option("basePath", folder).parquet(folder)
    return saved.where(F.col("model").isin(models) & (F.col("seed") == seed) & (F.col("k") == folds))


ship(__name__)
