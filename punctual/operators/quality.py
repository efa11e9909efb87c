"""Observation quality: flags, pass/fail, and the quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from punctual.functions.times import represented_within, seconds_between
from punctual.schemas import (
    DEFAULT_EXCLUSIONS,
    MAX_ABS_DELAY_SECONDS,
    OBSERVATION_SCHEMA,
    POST_TRIP_GRACE_SECONDS,
    PRE_TRIP_GRACE_SECONDS,
    QUALITY_FLAGS,
    QUALITY_MODES,
    STALE_SECONDS,
    STOP_CALL_DISAGREEMENT_SECONDS,
    conform,
)


#: Which part of its poll an observation is stored with.
POLL_PART = "poll_part"


def any_of(columns) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c) if isinstance(c, str) else c for c in columns])


def is_analysis_row() -> Column:
    return (
        (F.col("is_gtfs_matchable") == 1)
        & F.col("delay_seconds").isNotNull()
        & F.col("line_ref").isNotNull()
    )


def analysis_rows(observations: DataFrame, polls: DataFrame | None = None) -> DataFrame:
    """Rows that can be analysed, with the collection time of their poll.

    The filter precedes the join. No broadcast hint: polls grow with the data,
    so the optimizer decides on their size and AQE splits a skewed poll. Tables
    of `write_colocated` meet in their buckets, by poll and part.
    """
    parted = polls is not None and POLL_PART in observations.columns and POLL_PART in polls.columns
    part = [POLL_PART] if parted else []
    rows = conform(observations, OBSERVATION_SCHEMA).filter(is_analysis_row())
    rows = rows.select([*[f.name for f in OBSERVATION_SCHEMA if f.name != "is_gtfs_matchable"], *part])
    if polls is None:
        return rows.withColumn("collected_at_utc", F.lit(None).cast("timestamp"))
    poll_times = polls.select(F.col("id").alias("poll_id"), "collected_at_utc", *part)
    return rows.join(poll_times, ["poll_id", *part], "left").drop(*part)


def with_quality_flags(
    rows: DataFrame,
    *,
    max_abs_delay_seconds: int = MAX_ABS_DELAY_SECONDS,
    stale_seconds: int = STALE_SECONDS,
    pre_trip_grace_seconds: int = PRE_TRIP_GRACE_SECONDS,
    post_trip_grace_seconds: int = POST_TRIP_GRACE_SECONDS,
    stop_call_disagreement_seconds: int = STOP_CALL_DISAGREEMENT_SECONDS,
) -> DataFrame:
    """Add ages, the stop-call comparison, five flags and their count.

    Comparisons are strict and an unknown operand raises no flag.
    """
    if "collected_at_utc" not in rows.columns:
        rows = rows.withColumn("collected_at_utc", F.lit(None).cast("timestamp"))
    rows = conform(rows, OBSERVATION_SCHEMA)
    collected = F.col("quality_collected_at_utc")
    recorded = F.col("recorded_at_utc")

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    def seconds(amount: int) -> Column:
        return F.make_dt_interval(secs=F.lit(amount))

    return (
        rows.withColumn("quality_collected_at_utc", F.coalesce("collected_at_utc", "created_at_utc"))
        .withColumns(
            {
                "observation_age_seconds": seconds_between(recorded, collected),
                "validity_lag_seconds": seconds_between(F.col("valid_until_utc"), collected),
                "stop_call_delay_seconds": F.coalesce(
                    seconds_between("next_aimed_arrival_time_utc", "next_expected_arrival_time_utc"),
                    seconds_between("next_aimed_departure_time_utc", "next_expected_departure_time_utc"),
                ),
            }
        )
        .withColumn(
            "stop_call_delay_diff_seconds",
            F.abs(F.col("stop_call_delay_seconds") - F.col("delay_seconds")),
        )
        .withColumns(
            {
                "is_implausible_delay": flag(F.abs("delay_seconds") > max_abs_delay_seconds),
                "is_stale_observation": flag(F.col("observation_age_seconds") > stale_seconds)
                | flag(F.col("valid_until_utc") < collected),
                "is_pre_trip_observation": flag(
                    recorded < F.col("origin_aimed_departure_time_utc") - seconds(pre_trip_grace_seconds)
                ),
                "is_post_trip_observation": flag(
                    recorded > F.col("destination_aimed_arrival_time_utc") + seconds(post_trip_grace_seconds)
                ),
                "has_stop_call_disagreement": flag(
                    F.col("stop_call_delay_diff_seconds") > stop_call_disagreement_seconds
                ),
            }
        )
        .withColumn(
            "quality_issue_count", reduce(lambda a, b: a + b, [F.col(c).cast("int") for c in QUALITY_FLAGS])
        )
    )


def with_quality_pass(
    flagged: DataFrame, mode: str = "conservative", exclude_stop_call_disagreement: bool = False
) -> DataFrame:
    """Every row passes unless the mode is conservative."""
    if mode not in QUALITY_MODES:
        raise ValueError(f"quality mode must be one of {', '.join(QUALITY_MODES)}")
    if mode != "conservative":
        return flagged.withColumn("quality_pass", F.lit(True))
    exclusions = QUALITY_FLAGS if exclude_stop_call_disagreement else DEFAULT_EXCLUSIONS
    return flagged.withColumn("quality_pass", ~any_of(exclusions))


def quality_rows(
    observations: DataFrame,
    polls: DataFrame | None = None,
    *,
    mode: str = "conservative",
    exclude_stop_call_disagreement: bool = False,
    **thresholds: int,
) -> DataFrame:
    """Analysis rows with every quality column; nothing is dropped yet."""
    flagged = with_quality_flags(analysis_rows(observations, polls), **thresholds)
    return with_quality_pass(flagged, mode, exclude_stop_call_disagreement)


def select_rows(rows: DataFrame, *, start=None, end=None, line=None, direction=None, has_stop=False) -> DataFrame:
    """Narrow rows before bucketing; a window here changes which polls a bucket holds."""
    if start is not None or end is not None:
        rows = rows.filter(represented_within(start, end))
    if line is not None:
        rows = rows.filter(F.col("line_ref") == line)
    if direction is not None:
        rows = rows.filter(F.col("direction_ref") == direction)
    return rows.filter(F.col("next_stop_point_ref").isNotNull()) if has_stop else rows


def quality_counts(rows: DataFrame) -> DataFrame:
    """Rows per line, name and combination of flags: all the quality reports need.

    Plain hash aggregation over at most 32 flag combinations per line name, so
    a hot line is combined on the map side.
    """
    return rows.groupBy("line_ref", "published_line_name", *QUALITY_FLAGS).agg(
        F.count(F.lit(1)).alias("row_count"), F.min("recorded_at_utc").alias("first_recorded")
    )


def counted(condition: Column | str) -> Column:
    condition = F.col(condition) if isinstance(condition, str) else condition
    return F.sum(F.when(condition, F.col("row_count")).otherwise(F.lit(0)))


def quality_summary(counts: DataFrame) -> DataFrame:
    """Count and share of each check, long form; no rows for no input."""
    checks = {"analysis_rows": F.lit(True), **{c: F.col(c) for c in QUALITY_FLAGS}}
    checks["conservative_excluded_default"] = any_of(DEFAULT_EXCLUSIONS)
    checks["conservative_excluded_with_stop_call_disagreement"] = any_of(QUALITY_FLAGS)
    totals = counts.agg(F.sum("row_count").alias("_total"), *[counted(c).alias(n) for n, c in checks.items()])
    return (
        totals.filter(F.col("_total") > 0)
        .unpivot(["_total"], list(checks), "quality_check", "row_count")
        .select("quality_check", "row_count", (F.col("row_count") / F.col("_total") * 100.0).alias("pct_rows"))
    )


LINE_COUNTS = {
    "implausible_delay_rows": "is_implausible_delay",
    "stale_rows": "is_stale_observation",
    "pre_trip_rows": "is_pre_trip_observation",
    "post_trip_rows": "is_post_trip_observation",
    "stop_call_disagreement_rows": "has_stop_call_disagreement",
}


def quality_by_line(counts: DataFrame, min_observations: int = 1, limit: int | None = None) -> DataFrame:
    """Flag counts per line, worst share first."""
    name = F.col("published_line_name")
    named = F.when(name.isNotNull(), F.struct(F.col("first_recorded").isNull(), F.col("first_recorded"), name))
    result = (
        counts.groupBy("line_ref")
        .agg(
            F.min_by(name, named).alias("line_name"),
            F.sum("row_count").alias("_rows"),
            *[counted(flag).alias(alias) for alias, flag in LINE_COUNTS.items()],
            counted(any_of(DEFAULT_EXCLUSIONS)).alias("conservative_excluded_rows"),
        )
        .filter(F.col("_rows") >= min_observations)
        .withColumn("conservative_excluded_pct", F.col("conservative_excluded_rows") / F.col("_rows") * 100.0)
        .orderBy(F.desc("conservative_excluded_pct"), F.desc("conservative_excluded_rows"), "line_ref")
        .select(
            "line_ref",
            "line_name",
            F.col("_rows").alias("row_count"),
            *LINE_COUNTS,
            "conservative_excluded_rows",
            "conservative_excluded_pct",
        )
    )
    return result.limit(limit) if limit is not None else result


EXAMPLE_COLUMNS = (
    "recorded_at_utc",
    "line_ref",
    "direction_ref",
    "vehicle_id",
    "trip_match_key",
    "next_stop_point_ref",
    "delay_min",
    "observation_age_seconds",
    "stop_call_delay_diff_seconds",
    *QUALITY_FLAGS,
)


def quality_examples(rows: DataFrame, limit: int = 20) -> DataFrame:
    """Flagged rows, most issues first, then oldest."""
    return (
        rows.filter(F.col("quality_issue_count") > 0)
        .withColumn("delay_min", F.col("delay_seconds") / 60.0)
        .orderBy(F.desc("quality_issue_count"), F.asc_nulls_last("recorded_at_utc"), "id")
        .limit(limit)
        .select("id", *EXAMPLE_COLUMNS)
    )
