"""Scratch tables in the shared folder, and functions that executors get by value."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def ship(module: str) -> None:
    """Send a module's functions to the Python workers by value, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only where no folder is named and all runs on one machine (tests, a laptop) does this make a temporary one, which goes
    when the process ends; on a cluster without the setting it raises, as executors couldn't see such a folder.
    """
    context = spark.sparkContext
    if named := context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="sorrel-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    context.setCheckpointDir(made)
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/sorrel-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_folder = path.rsplit("/", 1)[0]
    return back


def forget(*tables: DataFrame | None) -> None:
    """Delete the files of tables that written() gave and that nothing will read again."""
    for df in tables:
        if df is not None and (folder := getattr(df, "scratch_folder", None)):
            remove(df.sparkSession, folder)


def remove(spark: SparkSession, folder: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
