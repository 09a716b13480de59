"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Every timestamp in the library is wall-clock time held as TIMESTAMP_NTZ, so the session zone has to be UTC.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot user or place may hold a third of the rows: let AQE split that join partition,
    # even where splitting costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def build_session(app: str = "footfall", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; sizing is left to the caller or to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of ``spark.checkpoint.dir``, which has to be a folder that every executor can reach."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and every executor can reach")
    path = os.path.join(root, f"{name}-{uuid.uuid4().hex}")
    for opened in _open_scratch:
        opened.append(path)
    return path


_open_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end all scratch folders made inside; results have to be read or written before that."""
    made: list[str] = []
    _open_scratch.append(made)
    try:
        yield made
    finally:
        _open_scratch.remove(made)
        discard(spark, made)


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes scratch folders that nothing reads any more."""
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of jobs whose DataFrames are gone; it does so when the JVM collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes ``df`` to a fresh scratch folder and reads it back.

    For a table that several branches of a plan read: it is computed once, later scans prune its columns, its lineage
    ends there, and a lost executor costs a re-read instead of the whole computation.
    """
    path = scratch_folder(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
