"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F

_job_folder: ContextVar[str | None] = ContextVar("job_folder", default=None)
_ending: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on; sizing stays with the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Percentile and first-value states hold a few numbers per bucket. The default of 128 groups a task
    # makes every bucket aggregation fall back to sorting; this many take some tens of megabytes.
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "65536")
    return spark


def build_session(app_name: str = "punctual", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where that is unset, a folder of the warehouse, as shared as its tables.

    A warehouse on a machine's own disk serves one machine only: on a cluster each executor would write to its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    one_machine = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
    if not one_machine and re.match(r"file:|/|(?![a-z0-9+.-]+:)", warehouse):
        raise RuntimeError(f"set spark.checkpoint.dir: executors do not share {warehouse}")
    return f"{warehouse}/scratch".rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def application_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, deleted when its driver ends."""
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    if folder not in _ending:
        _ending.add(folder)
        atexit.register(_delete_at_end, spark, folder)
    return folder


def _delete_at_end(spark: SparkSession, folder: str) -> None:
    # A session that was stopped before can delete nothing any more.
    if spark.sparkContext._jsc is not None:
        delete(spark, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Owns the tables materialised inside the block and deletes them at its end."""
    folder = f"{application_folder(spark)}/job-{uuid.uuid4().hex}"
    token = _job_folder.set(folder)
    try:
        yield folder
    finally:
        _job_folder.reset(token)
        delete(spark, folder)


def written(df: DataFrame, path: str, by_day: str | None = None) -> DataFrame:
    """Write Parquet and return it read back, so that later steps start from the file.

    With `by_day` there is a folder for each value of that column, so that a
    range of days reads its own files only; a day too large for one task is
    rebalanced over several.
    """
    stored = df.sparkSession.read.schema(df.schema)
    if by_day is None:
        df.write.mode("overwrite").parquet(path)
        return stored.parquet(path)
    df.hint("rebalance", F.col(by_day)).write.mode("overwrite").partitionBy(by_day).parquet(path)
    return stored.parquet(path).select(*df.columns)


def materialise(df: DataFrame, name: str, by_day: str | None = None) -> DataFrame:
    """Write a table several later steps read, and return it read back.

    Unlike a checkpointed RDD the Parquet copy keeps column pruning, filter
    pushdown and size statistics, and it survives the loss of executors. It
    lives as long as the enclosing `scratch` block, or else the application.
    """
    folder = _job_folder.get() or application_folder(df.sparkSession)
    return written(df, f"{folder}/{name}-{uuid.uuid4().hex}", by_day)
