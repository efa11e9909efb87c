"""Gaps in data collection: cadence, blackouts, missing spots.

One source may hold a third of all polls, so no window runs over a whole
source. Polls are ordered inside (source, hour) slices, and what precedes a
slice comes from a table with one row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from punctual.functions.times import second_text, seconds_between
from punctual.schemas import POLL_SCHEMA, conform

def same_source_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the source, NULL being a source like any other."""
    other = right.withColumnRenamed("source", "_source")
    return left.join(other, left["source"].eqNullSafe(other["_source"]), how).drop("_source")


def is_success() -> Column:
    return F.coalesce(F.col("ok") == 1, F.lit(False))


def collector_polls(polls: DataFrame, source: str | None = None) -> DataFrame:
    """Typed polls in source and attempt order, of one source if given."""
    typed = conform(polls, POLL_SCHEMA)
    if source is not None:
        typed = typed.filter(F.col("source") == source)
    return typed.orderBy("source", "attempted_at_utc", "id")


def with_previous_success(polls: DataFrame) -> DataFrame:
    """Add the collection time of the latest earlier success of the same source.

    Successes stand at their collection time, failures at their attempt time;
    at equal times successes come first.
    """
    polls = polls.withColumn("_at", F.when(is_success(), F.col("collected_at_utc")).otherwise(F.col("attempted_at_utc")))
    polls = polls.withColumns(
        {"_slice": F.date_trunc("hour", "_at"), "_success_at": F.when(is_success(), F.col("_at"))}
    )
    # Polls without a time precede and follow nothing; each is a slice of its own, not all of them one.
    untimed = F.when(F.col("_slice").isNull(), F.xxhash64("id"))
    within_slice = (
        Window.partitionBy("source", "_slice", "_untimed")
        .orderBy("_at", F.desc(is_success().cast("int")), "id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier_hours = Window.partitionBy("_source").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    # One row per source and hour: its size depends on the time span, not on the polls.
    carried = (
        polls.filter(F.col("_slice").isNotNull())
        .groupBy(F.col("source").alias("_source"), F.col("_slice").alias("_hour"))
        .agg(F.max("_success_at").alias("_last"))
        .select(
            "_source",
            "_hour",
            F.max("_last").over(earlier_hours).alias("_carried"),
        )
    )
    ordered = polls.withColumn("_untimed", untimed).withColumn(
        "_in_slice", F.last("_success_at", ignorenulls=True).over(within_slice)
    )
    matched = ordered.join(
        carried, ordered["source"].eqNullSafe(carried["_source"]) & (ordered["_slice"] == carried["_hour"]), "left"
    )
    return matched.withColumn("_previous_success", F.coalesce("_in_slice", "_carried")).drop(
        "_at", "_slice", "_success_at", "_untimed", "_in_slice", "_carried", "_source", "_hour", "_last"
    )


def gap_histogram(polls: DataFrame) -> DataFrame:
    """Polls counted per (source, outcome, recorded gap)."""
    return (
        polls.withColumn("_success", is_success())
        .groupBy("source", "_success", F.col("gap_seconds_since_previous_success").alias("gap"))
        .agg(
            F.count(F.lit(1)).alias("polls"),
            F.sum("row_count").alias("rows"),
            F.count("row_count").alias("rows_known"),
        )
    )


def profile_aggregates() -> dict[str, Column]:
    """Poll counts, expected cadence and mean rows of a success, over histogram rows."""
    success, polls = F.col("_success"), F.col("polls")
    positive_gap = F.when(success & (F.col("gap") > 0), F.col("gap"))
    return {
        "poll_count": F.sum(polls),
        "success_count": F.sum(F.when(success, polls).otherwise(0)),
        "failed_count": F.sum(F.when(success, 0).otherwise(polls)),
        "expected_cadence_seconds": F.percentile(positive_gap, 0.5, polls),
        "_rows": F.sum(F.when(success, F.col("rows"))),
        "_rows_known": F.sum(F.when(success, F.col("rows_known"))),
    }


def source_profile(histogram: DataFrame) -> DataFrame:
    """Expected cadence and mean rows of a success per source."""
    profile = histogram.groupBy("source").agg(*[a.alias(n) for n, a in profile_aggregates().items()])
    return profile.withColumn("avg_rows_per_success", F.try_divide("_rows", "_rows_known")).drop("_rows", "_rows_known")


def excess(gap: str = "gap") -> Column:
    return F.greatest(F.lit(0.0), F.col(gap) - F.col("expected_cadence_seconds"))


def collector_blackouts(polls: DataFrame, limit: int | None = None) -> DataFrame:
    """Gaps above twice the cadence, summed per source; every source appears.

    The profile, one row per source, is joined back to the histogram: no task
    holds all gaps of a source, and both sides share one grouping of the polls.
    """
    histogram = gap_histogram(conform(polls, POLL_SCHEMA))
    profile = histogram.groupBy("source").agg(*[a.alias(n) for n, a in profile_aggregates().items()])
    profiled = same_source_join(histogram, profile)
    is_blackout = F.col("_success") & (F.col("gap") > 0) & (F.col("gap") > 2 * F.col("expected_cadence_seconds"))
    missed = F.col("_blackout") / F.col("expected_cadence_seconds")
    rows = F.try_divide("_rows", "_rows_known")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value * F.col("polls")), F.lit(0.0))

    result = (
        profiled.withColumn("_blackout", F.when(is_blackout, excess()))
        .groupBy("source")
        .agg(
            *[F.max(c).alias(c) for c in ("poll_count", "success_count", "failed_count", "expected_cadence_seconds")],
            F.sum(F.when(is_blackout, F.col("polls")).otherwise(0)).alias("blackout_count"),
            (total(F.col("_blackout")) / 60.0).alias("total_blackout_min"),
            (F.coalesce(F.max("_blackout"), F.lit(0.0)) / 60.0).alias("largest_blackout_min"),
            total(missed).alias("estimated_missed_polls"),
            total(missed * rows).alias("estimated_missed_rows"),
        )
        .orderBy(F.desc("total_blackout_min"), F.desc("blackout_count"), "source")
    )
    return result.limit(limit) if limit is not None else result


def success_gaps(
    polls: DataFrame,
    gap_multiplier: float = 2.0,
    min_missing_minutes: float = 0.0,
    cadence_seconds: float | None = None,
) -> DataFrame:
    """Success-to-success gaps above the multiple of the cadence, with the failures inside.

    The cadence is each source's own, its median gap, unless one for all is given.

    All that follows a success up to the next one shares its time as
    `_previous_success`, so one grouping finds both the end of the gap and its
    failures, without a time range join. What happens at that very time is
    outside the gap. Polls that already carry `_previous_success` keep it.
    """
    polls = conform(polls, POLL_SCHEMA)
    followed = polls if "_previous_success" in polls.columns else with_previous_success(polls)
    profile = source_profile(gap_histogram(polls)).select(
        "source", "expected_cadence_seconds", "avg_rows_per_success"
    )
    if cadence_seconds is not None:
        profile = profile.withColumn("expected_cadence_seconds", F.lit(float(cadence_seconds)))
    at = F.when(is_success(), F.col("collected_at_utc")).otherwise(F.col("attempted_at_utc"))
    ending = F.when(is_success(), F.struct(F.col("collected_at_utc").alias("at"), "status"))
    gaps = (
        followed.filter(F.col("_previous_success") < at)
        .groupBy("source", F.col("_previous_success").alias("gap_start_utc"))
        .agg(F.min(ending).alias("_end"), F.count_if(~is_success()).alias("failed_attempt_count"))
        .filter(F.col("_end").isNotNull())
        .select(
            "source",
            "gap_start_utc",
            F.col("_end.at").alias("gap_end_utc"),
            seconds_between(F.col("gap_start_utc"), F.col("_end.at")).cast("double").alias("gap_seconds"),
            F.col("_end.status").alias("next_success_status"),
            "failed_attempt_count",
        )
    )
    return (
        same_source_join(gaps, profile)
        .withColumn("missing_seconds", excess("gap_seconds"))
        .filter(
            (F.col("gap_seconds") > gap_multiplier * F.col("expected_cadence_seconds"))
            & (F.col("missing_seconds") >= min_missing_minutes * 60.0)
        )
    )


def missing_spots(gaps: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per gap of `success_gaps`, largest first."""
    missed = F.col("missing_seconds") / F.col("expected_cadence_seconds")
    result = gaps.orderBy(F.desc("missing_seconds"), "source", "gap_start_utc").select(
        "source",
        second_text("gap_start_utc").alias("gap_start_utc"),
        second_text("gap_end_utc").alias("gap_end_utc"),
        (F.col("gap_seconds") / 60.0).alias("gap_min"),
        "expected_cadence_seconds",
        (F.col("missing_seconds") / 60.0).alias("missing_min"),
        missed.alias("estimated_missed_polls"),
        (missed * F.col("avg_rows_per_success")).alias("estimated_missed_rows"),
        "failed_attempt_count",
        "next_success_status",
    )
    return result.limit(limit) if limit is not None else result


def missing_summary(polls: DataFrame, gaps: DataFrame) -> DataFrame:
    """Totals of the gaps per source, zero for a source without any."""
    missed = F.col("missing_seconds") / F.col("expected_cadence_seconds")
    counts = polls.groupBy("source").agg(
        F.count(F.lit(1)).alias("poll_count"),
        F.count_if(is_success()).alias("success_count"),
        F.count_if(~is_success()).alias("failed_count"),
    )
    totals = gaps.groupBy("source").agg(
        F.count(F.lit(1)).alias("missing_spot_count"),
        (F.sum("missing_seconds") / 60.0).alias("total_missing_min"),
        (F.max("missing_seconds") / 60.0).alias("largest_missing_min"),
        F.sum(missed).alias("estimated_missed_polls"),
        F.sum(missed * F.col("avg_rows_per_success")).alias("estimated_missed_rows"),
    )
    measures = ["total_missing_min", "largest_missing_min", "estimated_missed_polls", "estimated_missed_rows"]
    return (
        same_source_join(counts, totals, "left")
        .fillna(0, ["missing_spot_count"])
        .fillna(0.0, measures)
        .orderBy(F.desc("total_missing_min"), F.desc("missing_spot_count"), "source")
    )
