"""Column layouts, default thresholds and the fixed names shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# Thresholds and defaults of the published analysis.
DEFAULT_TIMEZONE = "Europe/Helsinki"
DEFAULT_RUSH_WINDOWS = ("07:00-09:00", "15:00-18:00")
MAX_ABS_DELAY_SECONDS = 7200
STALE_SECONDS = 300
PRE_TRIP_GRACE_SECONDS = 900
POST_TRIP_GRACE_SECONDS = 1800
STOP_CALL_DISAGREEMENT_SECONDS = 600
QUALITY_MODES = ("conservative", "diagnostic", "raw")
BUCKET_MODES = ("poll", "trip-stop", "vehicle-trip", "line-hour")

# Layouts of the source tables, and the names of flags and metrics.
OBSERVATION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("poll_id", T.LongType()),
        T.StructField("vehicle_id", T.StringType()),
        T.StructField("recorded_at_utc", T.TimestampType()),
        T.StructField("valid_until_utc", T.TimestampType()),
        T.StructField("line_ref", T.StringType()),
        T.StructField("direction_ref", T.StringType()),
        T.StructField("origin_aimed_departure_time_utc", T.TimestampType()),
        T.StructField("trip_match_key", T.StringType()),
        T.StructField("is_gtfs_matchable", T.IntegerType()),
        T.StructField("published_line_name", T.StringType()),
        T.StructField("delay_seconds", T.DoubleType()),
        T.StructField("next_stop_point_ref", T.StringType()),
        T.StructField("next_stop_point_name", T.StringType()),
        T.StructField("next_aimed_arrival_time_utc", T.TimestampType()),
        T.StructField("next_expected_arrival_time_utc", T.TimestampType()),
        T.StructField("next_aimed_departure_time_utc", T.TimestampType()),
        T.StructField("next_expected_departure_time_utc", T.TimestampType()),
        T.StructField("destination_aimed_arrival_time_utc", T.TimestampType()),
        T.StructField("created_at_utc", T.TimestampType()),
    ]
)

POLL_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("attempted_at_utc", T.TimestampType()),
        T.StructField("collected_at_utc", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("ok", T.IntegerType()),
        T.StructField("row_count", T.DoubleType()),
        T.StructField("gap_seconds_since_previous_success", T.DoubleType()),
    ]
)

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("source_alert_id", T.StringType()),
        T.StructField("line_ref", T.StringType()),
        T.StructField("cause", T.StringType()),
        T.StructField("effect", T.StringType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("is_active", T.IntegerType()),
        T.StructField("validity_start_utc", T.TimestampType()),
        T.StructField("validity_end_utc", T.TimestampType()),
        T.StructField("affected_routes_json", T.StringType()),
        T.StructField("affected_stops_json", T.StringType()),
        T.StructField("created_at_utc", T.TimestampType()),
    ]
)

STOP_SCHEMA = T.StructType(
    [
        T.StructField("gtfs_feed_date", T.DateType()),
        T.StructField("stop_id", T.StringType()),
        T.StructField("gtfs_stop_name", T.StringType()),
        T.StructField("stop_lat", T.DoubleType()),
        T.StructField("stop_lon", T.DoubleType()),
    ]
)

ROUTE_SCHEMA = T.StructType(
    [
        T.StructField("gtfs_feed_date", T.DateType()),
        T.StructField("route_id", T.StringType()),
        T.StructField("route_short_name", T.StringType()),
    ]
)

QUALITY_FLAGS = (
    "is_implausible_delay",
    "is_stale_observation",
    "is_pre_trip_observation",
    "is_post_trip_observation",
    "has_stop_call_disagreement",
)
# The stop-call check is opt-in; the other four always exclude in conservative mode.
DEFAULT_EXCLUSIONS = QUALITY_FLAGS[:4]

METRIC_COLUMNS = (
    "bucket_count",
    "raw_poll_count",
    "signed_mean_delay_min",
    "avg_delay_min",
    "median_delay_min",
    "p75_delay_min",
    "p90_delay_min",
    "p95_delay_min",
    "pct_late",
    "pct_over_3_min_late",
    "pct_over_5_min_late",
    "pct_early",
    "pct_over_1_min_early",
    "pct_over_3_min_early",
    "median_early_min_abs",
    "p90_early_min_abs",
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast the columns of `schema`, add the absent ones as NULL, keep any others.

    Text that does not parse becomes NULL, as does an out-of-range number.
    """
    casts = {}
    for field in schema.fields:
        if field.name not in df.columns:
            casts[field.name] = F.lit(None).cast(field.dataType)
            continue
        present = df.schema[field.name].dataType
        if present == field.dataType:
            continue
        if isinstance(present, T.StringType) and isinstance(field.dataType, T.TimestampType):
            casts[field.name] = F.try_to_timestamp(F.col(field.name))
        else:
            casts[field.name] = F.col(field.name).try_cast(field.dataType)
    return df.withColumns(casts) if casts else df
