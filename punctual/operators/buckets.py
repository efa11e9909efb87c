"""Collapse repeated polls of one vehicle at one stop into delay buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from punctual.functions.times import representative_time, second_text, with_local_calendar
from punctual.operators.metrics import earliest
from punctual.schemas import BUCKET_MODES, DEFAULT_TIMEZONE, OBSERVATION_SCHEMA, conform

BUCKET_KEYS = {
    "trip-stop": ("trip_match_key", "vehicle_id", "line_ref", "direction_ref", "next_stop_point_ref"),
    "vehicle-trip": ("trip_match_key", "vehicle_id", "line_ref", "direction_ref"),
    "line-hour": ("line_ref", "direction_ref", "local_date", "local_hour", "day_type"),
}

BUCKET_COLUMNS = (
    "bucket_id",
    "bucket_mode",
    "line_ref",
    "direction_ref",
    "published_line_name",
    "delay_seconds",
    "delay_min",
    "raw_poll_count",
    "next_stop_point_ref",
    "next_stop_point_name",
    "representative_time_utc",
    "recorded_at_utc",
    "first_recorded_at_utc",
    "last_recorded_at_utc",
    "local_time",
    "local_date",
    "local_hour",
    "local_weekday",
    "is_weekday",
    "day_type",
    "local_minutes",
)


def bucketable(rows: DataFrame) -> DataFrame:
    """Rows that pass quality and have a delay, a line and a time."""
    rows = conform(rows, OBSERVATION_SCHEMA)
    if "quality_pass" in rows.columns:
        rows = rows.filter("quality_pass")
    return (
        rows.withColumn("representative_time_utc", representative_time())
        .filter(
            F.col("delay_seconds").isNotNull()
            & F.col("line_ref").isNotNull()
            & F.col("representative_time_utc").isNotNull()
        )
        .withColumns(
            {
                "direction_ref": F.coalesce("direction_ref", F.lit("Unknown")),
                "published_line_name": F.coalesce("published_line_name", "line_ref"),
            }
        )
    )


def joined_id(keys) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("<NA>")) for k in keys])


def delay_buckets(rows: DataFrame, bucket: str = "trip-stop", timezone: str = DEFAULT_TIMEZONE) -> DataFrame:
    """One row per bucket: median delay, polls, first names, time span.

    A NULL key is a value, so polls without a trip may share one huge bucket.
    Polls are therefore counted per (bucket, delay) before the bucket is put
    together, as the metric set does for its groups.
    """
    if bucket not in BUCKET_MODES:
        raise ValueError(f"bucket must be one of {', '.join(BUCKET_MODES)}")
    rows = bucketable(rows)
    if bucket == "poll":
        grouped = poll_buckets(rows)
    else:
        keys = BUCKET_KEYS[bucket]
        if bucket == "line-hour":
            rows = with_local_calendar(rows, "representative_time_utc", timezone)
        per_delay = rows.groupBy(*keys, "published_line_name", "next_stop_point_name", "delay_seconds").agg(
            F.count(F.lit(1)).alias("polls"),
            F.min("representative_time_utc").alias("seen"),
            F.min("recorded_at_utc").alias("first_recorded"),
            F.max("recorded_at_utc").alias("last_recorded"),
        )
        # Explicit, because map-side partial percentiles of tiny groups only cost time.
        grouped = per_delay.repartition(*keys).groupBy(*keys).agg(
            F.percentile("delay_seconds", 0.5, F.col("polls")).alias("delay_seconds"),
            F.sum("polls").alias("raw_poll_count"),
            earliest("published_line_name", "seen").alias("published_line_name"),
            earliest("next_stop_point_name", "seen").alias("next_stop_point_name"),
            F.min("seen").alias("representative_time_utc"),
            F.min("first_recorded").alias("recorded_at_utc"),
            F.max("last_recorded").alias("last_recorded_at_utc"),
        )
        grouped = grouped.withColumns(
            {"bucket_id": joined_id(keys), "first_recorded_at_utc": F.col("recorded_at_utc")}
        )
        if "next_stop_point_ref" not in keys:
            grouped = grouped.withColumn("next_stop_point_ref", F.lit(None).cast("string"))
    return (
        with_local_calendar(grouped, "representative_time_utc", timezone)
        .withColumns({"delay_min": F.col("delay_seconds") / 60.0, "bucket_mode": F.lit(bucket)})
        .select(*BUCKET_COLUMNS)
    )


def poll_buckets(rows: DataFrame) -> DataFrame:
    """Every poll is its own bucket; rows without an id get a hash of their content."""
    content = F.xxhash64(*[c for c in rows.columns if c != "id"]).cast("string")
    return rows.withColumns(
        {
            "bucket_id": F.coalesce(F.col("id").cast("string"), content),
            "raw_poll_count": F.lit(1).cast("long"),
            "first_recorded_at_utc": F.col("recorded_at_utc"),
            "last_recorded_at_utc": F.col("recorded_at_utc"),
        }
    )


def bucket_summary(buckets: DataFrame) -> DataFrame:
    return buckets.agg(
        F.count(F.lit(1)).alias("bucket_count"),
        F.coalesce(F.sum("raw_poll_count"), F.lit(0)).alias("raw_poll_count"),
        F.count_distinct("line_ref").alias("line_count"),
        second_text(F.min("representative_time_utc")).alias("observation_start_utc"),
        second_text(F.max("representative_time_utc")).alias("observation_end_utc"),
        F.min("local_date").alias("local_start_date"),
        F.max("local_date").alias("local_end_date"),
    )
