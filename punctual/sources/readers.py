"""Reading the source tables and the result tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from punctual.operators.quality import is_analysis_row
from punctual.plans.tables import Tables
from punctual.schemas import ALERT_SCHEMA, OBSERVATION_SCHEMA, POLL_SCHEMA, conform


def read_optional(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame | None:
    """A table, or None where the path does not exist."""
    try:
        return spark.read.options(**options).format(format).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_source_tables(spark: SparkSession, root: str, format: str = "parquet", **options) -> Tables:
    """Observations, and polls and alerts if present, as typed tables.

    Times may be typed or ISO text; the typed columns are what operators read.
    """

    def typed(name, schema):
        table = read_optional(spark, f"{root}/{name}", format, **options)
        return conform(table, schema) if table is not None else None

    observations = typed("vehicle_observations", OBSERVATION_SCHEMA)
    if observations is None:
        raise FileNotFoundError(f"no vehicle_observations under {root}")
    return Tables(
        observations=observations,
        polls=typed("collector_polls", POLL_SCHEMA),
        alerts=typed("service_alerts", ALERT_SCHEMA),
    )


def read_jdbc_table(
    spark: SparkSession, url: str, table: str, *, key: str = "id", bounds: tuple[int, int], partitions: int, **options
) -> DataFrame:
    """A database table read in parallel id ranges; rows outside the bounds are kept."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn=key,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(partitions),
            **options,
        )
        .load()
    )


def read_sql(spark: SparkSession, query: str, params: Mapping[str, object] | None = None, **tables: DataFrame) -> DataFrame:
    """A parameterised statement; `:name` marks parameters, `{name}` the given tables."""
    return spark.sql(query, args=dict(params or {}), **tables)


def limited(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows.limit(limit) if limit is not None else rows


def read_result(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A result table; an empty table without columns where none was written."""
    table = read_optional(spark, f"{root}/{name}")
    return table if table is not None else spark.createDataFrame([], "struct<>")


def source_summary(
    observations: DataFrame, polls: DataFrame | None = None, alerts: DataFrame | None = None
) -> DataFrame:
    """Row counts, newest id and time span of all rows and of the analysis rows, one row."""
    analysis = is_analysis_row()
    recorded = F.col("recorded_at_utc")
    profile = observations.agg(
        F.count(F.lit(1)).alias("vehicle_observation_count"),
        F.coalesce(F.max("id"), F.lit(0)).alias("vehicle_observation_max_id"),
        F.min(recorded).alias("vehicle_observation_start_utc"),
        F.max(recorded).alias("vehicle_observation_end_utc"),
        F.count_if(analysis).alias("analysis_row_count"),
        F.coalesce(F.max(F.when(analysis, F.col("id"))), F.lit(0)).alias("analysis_row_max_id"),
        F.min(F.when(analysis, recorded)).alias("analysis_start_utc"),
        F.max(F.when(analysis, recorded)).alias("analysis_end_utc"),
    )

    def count(table: DataFrame | None):
        return F.lit(0).cast("long") if table is None else table.agg(F.count(F.lit(1))).scalar()

    return profile.select(
        "*", count(polls).alias("collector_poll_count"), count(alerts).alias("service_alert_count")
    )
