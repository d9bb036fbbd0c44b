"""What the document table holds, as keys: 16 bytes for the id and for the content's fingerprint of each document.

Keys lie beside the documents, by batch and bucket (a hidden folder, so readers of the table don't see it). A batch reads only
the buckets that its own keys fall into, and never the contents of stored documents. A batch's keys are replaced as a whole
when it runs again. compact() merges the keys of finished batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.scratch import remove
from sorrel.sources import files

#: Buckets that keys fall into; a batch of few rows touches as few of them.
BUCKETS = 256
SCHEMA = "key binary, bucket int, batch_id int"


def folder_of(folder: str) -> str:
    return f"{folder}/_keys"


def id_key(value: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.lit("i"), value.cast("string")).cast("binary")))


def print_key(value: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.lit("p"), value).cast("binary")))


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def known(spark: SparkSession, folder: str, wanted: DataFrame, before: int) -> DataFrame | None:
    """The keys of wanted (key) that documents of batches before the given one have; None where no keys were written yet. At most BUCKETS numbers come to the driver."""
    if not files.any_path(spark, f"{folder_of(folder)}/batch_id=*"):
        return None
    buckets = [r[0] for r in wanted.select(bucket(F.col("key"))).distinct().collect()]
    rows = spark.read.schema(SCHEMA).option("basePath", folder_of(folder)).parquet(folder_of(folder))
    return rows.where(F.col("bucket").isin(buckets) & (F.col("batch_id") < before)).select("key")


def without(rows: DataFrame, key: str, stored: DataFrame | None) -> DataFrame:
    """rows whose key isn't stored."""
    return rows if stored is None else rows.join(stored.withColumnRenamed("key", key).distinct(), key, "left_anti")


def store(documents: DataFrame, folder: str, batch_id: int, fingerprint: Column) -> None:
    """Write the keys of a batch's documents (review_id and what fingerprint is made of), in place of any that the batch wrote before."""
    each = documents.select(F.explode(F.array(id_key(F.col("review_id")), print_key(fingerprint))).alias("key")).withColumn("bucket", bucket(F.col("key")))
    each.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder_of(folder)}/batch_id={batch_id}")


def batches(spark: SparkSession, folder: str) -> list[int]:
    """The batches whose keys lie apart; below 0, what compact() merged."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder_of(folder)}/batch_id=*")
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return sorted(int(f.getPath().getName().split("=")[1]) for f in found or [])


def compact(spark: SparkSession, folder: str) -> None:
    """Merge the keys of all batches but the last, which may still run again. Stopped half way, it leaves some keys twice, which changes nothing."""
    *done, last = batches(spark, folder) or [0]
    if len(done) < 2:
        return
    rows = spark.read.schema(SCHEMA).option("basePath", folder_of(folder)).parquet(*[f"{folder_of(folder)}/batch_id={b}" for b in done])
    merged = rows.select("key", "bucket").distinct().repartition("bucket").sortWithinPartitions("key")
    merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder_of(folder)}/batch_id={min(done[0], 0) - 1}")
    for b in done:
        remove(spark, f"{folder_of(folder)}/batch_id={b}")
