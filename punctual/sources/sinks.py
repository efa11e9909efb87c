"""Writing results: Parquet tables, CSV exports and published JSON."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, functions as F, types as T

from punctual.functions.values import round_doubles
from punctual.operators.publish import SCHEMA_VERSION, check_counts, check_fields, contract_counts
from punctual.session import delete, written


def write_table(df: DataFrame, root: str, name: str, by_day: str | None = None) -> DataFrame:
    """Write a table of a result folder and return it read back; `by_day` as in `session.written`."""
    return written(df, f"{root}/{name}", by_day)


def write_tables(tables: Mapping[str, DataFrame], root: str, at_once: int = 4) -> dict[str, DataFrame]:
    """Write independent tables, a few jobs at a time: small results leave most of a cluster idle."""
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        jobs = {name: pool.submit(write_table, table, root, name) for name, table in tables.items()}
        return {name: job.result() for name, job in jobs.items()}


def write_csv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """CSV part files with headers; rows keep their order across the parts."""
    table = round_doubles(df, digits) if digits is not None else df
    table.write.mode("overwrite").option("header", True).csv(path)


def write_csv_file(df: DataFrame, path: str) -> None:
    """One CSV file of a small table, at exactly this path: timetable files have fixed names."""
    spark, parts = df.sparkSession, f"{path}.parts"
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(parts)
    source = spark.read.text(parts).inputFiles()
    names = spark._jvm.org.apache.hadoop.fs
    target = names.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not source or not store.rename(names.Path(unquote(source[0])), target):
        raise OSError(f"could not write {path}")
    delete(spark, parts)


def labelled_union(views: Mapping[str, DataFrame], label: str = "view") -> DataFrame:
    """Several views in one table, told apart by a leading label column."""
    result = None
    for name, view in views.items():
        part = view.select(F.lit(name).alias(label), *view.columns)
        result = part if result is None else result.unionByName(part, allowMissingColumns=True)
    if result is None:
        raise ValueError("no views to combine")
    return result


def publishable(df: DataFrame, digits: int = 2) -> DataFrame:
    """Columns in name order, doubles rounded, dates as text."""
    dates = {f.name: F.col(f.name).cast("string") for f in df.schema.fields if isinstance(f.dataType, T.DateType)}
    table = round_doubles(df, digits)
    table = table.withColumns(dates) if dates else table
    return table.select(*sorted(table.columns))


def write_json(
    df: DataFrame, path: str, *, name: str, required: Iterable[str] = (), local_paths: Iterable[str] = ()
) -> dict[str, int]:
    """Write JSON lines with NULLs kept and check the publication contract on the way; returns its counts.

    One job: the rows are counted as they are written, beside the target, and
    the folder takes its name only if the counts allow it. A task that runs
    twice can raise a count, but not from zero.
    """
    table = publishable(df.withColumn("schema_version", F.lit(SCHEMA_VERSION)))
    check_fields(name, table.schema, required)
    return write_checked(table, path, name, local_paths)


def write_checked(table: DataFrame, path: str, name: str, local_paths: Iterable[str] = ()) -> dict[str, int]:
    spark, aside = table.sparkSession, f"{path}.{uuid.uuid4().hex}"
    seen = Observation(f"publish-{uuid.uuid4().hex}")
    counts = [count.alias(key) for key, count in contract_counts(table.schema, local_paths).items()]
    try:
        table.observe(seen, *counts).write.option("ignoreNullFields", False).json(aside)
        check_counts(name, seen.get)
    except BaseException:
        delete(spark, aside)
        raise
    delete(spark, path)
    names = spark._jvm.org.apache.hadoop.fs
    target = names.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).rename(names.Path(aside), target):
        raise OSError(f"could not write {path}")
    return seen.get
