"""Line, context, hour and rush rankings over delay buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from punctual.functions.times import hour_label, is_rush
from punctual.operators.metrics import (
    delay_histogram,
    earliest,
    metric_aggregates,
    metric_outputs,
    sort_robust,
    summarize_delay_metrics,
)
from punctual.schemas import DEFAULT_RUSH_WINDOWS, METRIC_COLUMNS

LINE_NAME = {"line_name": "published_line_name"}

# Columns and orders of the published rankings.
LATE_COLUMNS = (
    "line_ref",
    "line_name",
    "bucket_count",
    "raw_poll_count",
    "signed_mean_delay_min",
    "median_delay_min",
    "p75_delay_min",
    "p90_delay_min",
    "p95_delay_min",
    "pct_over_3_min_late",
    "pct_over_5_min_late",
)
EARLY_COLUMNS = (
    "line_ref",
    "line_name",
    "bucket_count",
    "raw_poll_count",
    "signed_mean_delay_min",
    "median_delay_min",
    "pct_early",
    "pct_over_1_min_early",
    "pct_over_3_min_early",
    "median_early_min_abs",
    "p90_early_min_abs",
)
CONTEXT_KEYS = ["line_ref", "direction_ref", "local_hour", "day_type"]
LATE_ORDER = ("p90_delay_min", "pct_over_5_min_late", "bucket_count")
EARLY_ORDER = ("p90_early_min_abs", "pct_over_3_min_early", "bucket_count")


def top(metrics: DataFrame, descending, ties, limit: int | None) -> DataFrame:
    ordered = metrics.orderBy(*[F.desc(c) for c in descending], *ties)
    return ordered.limit(limit) if limit is not None else ordered


def numbered(limited: DataFrame) -> DataFrame:
    """Add the place of each row, from 1, in an ordered and limited result: such a result is one partition."""
    return limited.withColumn("position", F.monotonically_increasing_id() + 1)


def delay_cube(buckets: DataFrame, windows=DEFAULT_RUSH_WINDOWS, include_weekends: bool = False) -> DataFrame:
    """Histogram by line, direction, hour, day type and rush.

    Every ranking below accepts it in place of the buckets. Its size depends on
    the network and the range of delays, not on the length of the history, so a
    report scans the buckets once for all of them.
    """
    marked = buckets.withColumn("is_rush", is_rush(windows, include_weekends))
    keys = ["line_ref", "direction_ref", "local_hour", "day_type", "is_rush"]
    return delay_histogram(marked, keys, ["published_line_name"])


def cube_metrics(cube: DataFrame, min_observations: int = 1) -> DataFrame:
    """Metrics per line, context, hour, and line and rush, from one pass over the cube.

    One table, told apart by `grouping`; write it, as `cube_parts` reads it for each part.
    """
    grouped = cube.groupingSets(
        [["line_ref"], CONTEXT_KEYS, ["local_hour"], ["line_ref", "is_rush"]], *CONTEXT_KEYS, "is_rush"
    ).agg(
        F.when(F.grouping("line_ref") == 1, "hour")
        .when(F.grouping("direction_ref") == 0, "context")
        .when(F.grouping("is_rush") == 0, "rush")
        .otherwise("line")
        .alias("grouping"),
        earliest("published_line_name").alias("line_name"),
        *[a.alias(name) for name, a in metric_aggregates().items()],
    )
    kept = grouped.filter(F.col("bucket_count") >= min_observations)
    return kept.select("grouping", *CONTEXT_KEYS, "is_rush", "line_name", *metric_outputs())


def cube_parts(metrics: DataFrame) -> dict[str, DataFrame]:
    """The groupings of `cube_metrics`, each with its own keys and, where it has lines, their names."""
    keys = {"line": ["line_ref"], "context": CONTEXT_KEYS, "hour": ["local_hour"], "rush": ["line_ref", "is_rush"]}
    return {
        name: metrics.filter(F.col("grouping") == name).select(
            *own, *(["line_name"] if "line_ref" in own else []), *METRIC_COLUMNS
        )
        for name, own in keys.items()
    }


def line_metrics(buckets: DataFrame, min_observations: int = 1) -> DataFrame:
    return summarize_delay_metrics(buckets, ["line_ref"], min_observations=min_observations, first=LINE_NAME)


def robust_lines(buckets: DataFrame, min_observations: int = 1, limit: int | None = 20) -> DataFrame:
    return sort_robust(line_metrics(buckets, min_observations), ["line_ref"], limit)


def late_lines(metrics: DataFrame, limit: int | None = 20) -> DataFrame:
    return top(metrics, LATE_ORDER, ["line_ref"], limit).select(*LATE_COLUMNS)


def early_lines(metrics: DataFrame, limit: int | None = 20) -> DataFrame:
    return top(metrics, EARLY_ORDER, ["line_ref"], limit).select(*EARLY_COLUMNS)


def line_rankings(metrics: DataFrame, limit: int | None = 20) -> DataFrame:
    """Both rankings in one table, told apart by `ranking`."""
    late = late_lines(metrics, limit).withColumn("ranking", F.lit("late"))
    early = early_lines(metrics, limit).withColumn("ranking", F.lit("early"))
    both = late.unionByName(early, allowMissingColumns=True)
    return both.select("ranking", *[c for c in both.columns if c != "ranking"])


def context_metrics(
    buckets: DataFrame,
    min_observations: int = 1,
    limit: int | None = 20,
    *,
    line: str | None = None,
    direction: str | None = None,
    day_type: str | None = None,
) -> DataFrame:
    """Metrics per line, direction, hour and day type, worst first."""
    for column, value in (("line_ref", line), ("direction_ref", direction), ("day_type", day_type)):
        if value is not None:
            buckets = buckets.filter(F.col(column) == value)
    metrics = summarize_delay_metrics(buckets, CONTEXT_KEYS, min_observations=min_observations, first=LINE_NAME)
    return ranked_contexts(metrics, limit)


def ranked_contexts(metrics: DataFrame, limit: int | None = 20) -> DataFrame:
    ranked = sort_robust(metrics, CONTEXT_KEYS, limit).withColumn("hour_local", hour_label())
    lead = ["line_ref", "line_name", "direction_ref", "hour_local", "day_type"]
    return ranked.select(*lead, *[c for c in ranked.columns if c not in {*lead, "local_hour"}])


def hourly_profile(
    buckets: DataFrame,
    min_observations: int = 1,
    *,
    line: str | None = None,
    by: str = "hour",
    limit: int | None = None,
) -> DataFrame:
    """Metrics per local hour, in hour order or worst first (`by="robust"`)."""
    if line is not None:
        buckets = buckets.filter(F.col("line_ref") == line)
    metrics = summarize_delay_metrics(buckets, ["local_hour"], min_observations=min_observations)
    return ordered_hours(metrics, by, limit)


def ordered_hours(metrics: DataFrame, by: str = "hour", limit: int | None = None) -> DataFrame:
    if by == "robust":
        ordered = sort_robust(metrics, ["local_hour"], limit)
    else:
        ordered = metrics.orderBy("local_hour")
        ordered = ordered.limit(limit) if limit is not None else ordered
    return ordered.select(hour_label().alias("hour_local"), *metrics.columns[1:])


def rush_impact(
    buckets: DataFrame,
    min_observations: int = 1,
    limit: int | None = 20,
    *,
    windows=None,
    include_weekends: bool | None = None,
) -> DataFrame:
    """Rush against non-rush per line, for lines with enough buckets in both.

    Buckets that are already marked keep their marks, so windows cannot be given with them.
    """
    marked = buckets
    if "is_rush" not in buckets.columns:
        marked = buckets.withColumn("is_rush", is_rush(windows or DEFAULT_RUSH_WINDOWS, bool(include_weekends)))
    elif windows is not None or include_weekends is not None:
        raise ValueError("the input is already marked: give the windows where it is marked")
    metrics = summarize_delay_metrics(
        marked, ["line_ref", "is_rush"], min_observations=min_observations, first=LINE_NAME
    )
    return compared_rush(metrics, limit)


def compared_rush(metrics: DataFrame, limit: int | None = 20) -> DataFrame:
    """Both sides of each line next to each other, from metrics per line and rush."""
    compared = ("bucket_count", "raw_poll_count", "median_delay_min", "p90_delay_min", "pct_over_5_min_late")
    # At most two metric rows per line remain, so both sides come from one pass.
    paired = metrics.groupBy("line_ref").agg(
        F.coalesce(
            F.max(F.when(F.col("is_rush"), F.col("line_name"))), F.max(F.when(~F.col("is_rush"), F.col("line_name")))
        ).alias("line_name"),
        *[F.max(F.when(~F.col("is_rush"), F.col(c))).alias(f"{c}_non_rush") for c in compared],
        *[F.max(F.when(F.col("is_rush"), F.col(c))).alias(f"{c}_rush") for c in compared],
    )

    def lift(column: str):
        return F.col(f"{column}_rush") - F.col(f"{column}_non_rush")

    lifted = (
        paired.filter(F.col("bucket_count_rush").isNotNull() & F.col("bucket_count_non_rush").isNotNull())
        .withColumns(
            {
                "rush_median_delay_lift_min": lift("median_delay_min"),
                "rush_p90_delay_lift_min": lift("p90_delay_min"),
                "rush_over_5_min_late_pct_point_lift": lift("pct_over_5_min_late"),
            }
        )
    )
    return top(
        lifted,
        ("rush_p90_delay_lift_min", "rush_over_5_min_late_pct_point_lift", "bucket_count_rush"),
        ["line_ref"],
        limit,
    )
