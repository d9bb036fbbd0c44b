"""Spark session defaults shared by the command line, the tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "sorrel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; on a cluster, spark-submit supplies master and memory."""
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Tables of fewer bytes than one split of Spark's default size are dealt over all cores before work that is heavy by the row.
ONE_SPLIT = 128 << 20


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt over all cores where the whole table may stand in one task; larger tables are left as their files lie."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if size < ONE_SPLIT else rows
