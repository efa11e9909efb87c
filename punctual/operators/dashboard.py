"""Interactive views: filters, stop and line-hour metrics, heat and colour scales."""

from __future__ import annotations

from datetime import date, time
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from punctual.functions.values import natural_key
from punctual.operators.buckets import delay_buckets
from punctual.operators.metrics import summarize_delay_metrics
from punctual.operators.quality import quality_rows
from punctual.operators.rankings import EARLY_ORDER, LATE_ORDER, LINE_NAME, top
from punctual.operators.stops import with_stop_metadata
from punctual.schemas import DEFAULT_TIMEZONE

STOP_KEYS = ["stop_id", "stop_name", "stop_lat", "stop_lon"]
DELAY_METRICS = ("signed_mean_delay_min", "median_delay_min", "p75_delay_min", "p90_delay_min", "p95_delay_min")
COUNT_METRICS = ("bucket_count", "raw_poll_count")

# Quantiles and sizes of the map scales.
HEAT_CAP_QUANTILE = 0.99
COLOUR_QUANTILE = 0.95
MARKER_SIZES = (9.0, 30.0)


def normalise_buckets(buckets: DataFrame) -> DataFrame:
    """Cached buckets as the views expect them."""
    return buckets.withColumns(
        {
            "stop_id": F.col("next_stop_point_ref").cast("string"),
            "local_minute_of_day": F.col("local_minutes"),
            "delay_min": F.col("delay_seconds") / 60.0,
        }
    )


def prepare_observations(
    observations: DataFrame,
    polls: DataFrame | None,
    stops: DataFrame | None,
    timezone: str = DEFAULT_TIMEZONE,
) -> DataFrame:
    """Conservative trip-stop buckets with stop metadata and a recorded time."""
    buckets = delay_buckets(quality_rows(observations, polls), "trip-stop", timezone)
    kept = buckets.filter(F.col("recorded_at_utc").isNotNull())
    return with_stop_metadata(normalise_buckets(kept), stops)


def filter_options(buckets: DataFrame) -> DataFrame:
    """Date bounds and the sorted distinct lines and directions, one row.

    The distinct step precedes the collection, so the arrays hold the names only.
    """
    pairs = buckets.groupBy("line_ref", "direction_ref").agg(
        F.min("local_date").alias("min_date"), F.max("local_date").alias("max_date")
    )
    return pairs.agg(
        F.min("min_date").alias("min_date"),
        F.max("max_date").alias("max_date"),
        F.sort_array(F.collect_set(F.struct(natural_key("line_ref").alias("key"), F.col("line_ref")))).alias("_lines"),
        F.sort_array(F.collect_set("direction_ref")).alias("direction_options"),
    ).select("min_date", "max_date", F.col("_lines.line_ref").alias("line_options"), "direction_options")


# The day kinds a view offers, and what `is_weekday` must be for them.
DAY_KINDS = {"All days": None, "Weekdays": True, "Weekends": False}


def minute_of_day(value: time) -> int:
    return value.hour * 60 + value.minute


def in_range(column: str, low, high) -> Column:
    """low <= column <= high, an open end where a bound is None."""
    conditions = [F.col(column) >= F.lit(low)] if low is not None else []
    conditions += [F.col(column) <= F.lit(high)] if high is not None else []
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def one_of(column: str, values) -> Column:
    """Membership; no values at all leave the column free."""
    return F.col(column).isin([str(v) for v in values]) if values else F.lit(True)


def filter_buckets(
    buckets: DataFrame,
    *,
    start_date: date | None = None,
    end_date: date | None = None,
    lines=None,
    directions=None,
    days: str = "All days",
    start_time: time | None = None,
    end_time: time | None = None,
) -> DataFrame:
    """Buckets in all of: a date range, a range of minutes of the day (both inclusive), sets, a day kind."""
    if days not in DAY_KINDS:
        raise ValueError(f"days must be one of {', '.join(DAY_KINDS)}")
    minutes = [None if v is None else minute_of_day(v) for v in (start_time, end_time)]
    if None not in minutes and minutes[0] > minutes[1]:
        raise ValueError("start_time must not be after end_time")
    weekday = DAY_KINDS[days]
    return buckets.filter(
        in_range("local_date", start_date, end_date)
        & one_of("line_ref", lines)
        & one_of("direction_ref", directions)
        & (F.lit(True) if weekday is None else F.col("is_weekday") == weekday)
        & in_range("local_minutes", *minutes)
    )


def selection_summary(buckets: DataFrame) -> DataFrame:
    """Headline numbers of a selection; zeros when it is empty."""
    overall = summarize_delay_metrics(
        buckets, [], min_observations=0, distinct={"line_count": "line_ref", "stop_count": "next_stop_point_ref"}
    )
    columns = (
        "bucket_count",
        "raw_poll_count",
        "line_count",
        "stop_count",
        "median_delay_min",
        "p90_delay_min",
        "pct_over_5_min_late",
    )
    return overall.select(*[F.coalesce(F.col(c), F.lit(0).cast(overall.schema[c].dataType)).alias(c) for c in columns])


def line_hour_metrics(buckets: DataFrame, min_observations: int = 1) -> DataFrame:
    return summarize_delay_metrics(
        buckets, ["line_ref", "local_hour"], min_observations=min_observations, first=LINE_NAME
    )


def line_hour_grid(hourly: DataFrame, metric: str = "p90_delay_min") -> DataFrame:
    """One row per line with 24 hour columns, in display order."""
    value = F.sum("bucket_count") if metric in COUNT_METRICS else F.avg(metric)
    grid = hourly.groupBy("line_ref").agg(
        value.alias("sort_metric"),
        F.sum("bucket_count").alias("total_buckets"),
        *[F.max(F.when(F.col("local_hour") == h, F.col(metric))).alias(f"h{h:02d}") for h in range(24)],
    )
    return grid.orderBy(F.desc("sort_metric"), F.desc("total_buckets"), "line_ref")


def stop_metrics(buckets_with_stops: DataFrame, min_observations: int = 1) -> DataFrame:
    """Metrics per stop; absent coordinates are a key value, not a reason to drop."""
    return summarize_delay_metrics(
        buckets_with_stops, STOP_KEYS, min_observations=min_observations, distinct={"line_count": "line_ref"}
    )


def late_stops(metrics: DataFrame, limit: int = 20) -> DataFrame:
    return top(metrics, LATE_ORDER, STOP_KEYS, limit)


def early_stops(metrics: DataFrame, limit: int = 20) -> DataFrame:
    return top(metrics, EARLY_ORDER, STOP_KEYS, limit)


def heat_weights(metrics: DataFrame, metric: str, delay_direction: str = "late") -> DataFrame:
    """Positive map weights of located stops for one metric."""
    value, count = F.col(metric), F.col("bucket_count")
    if metric in DELAY_METRICS:
        if delay_direction not in ("late", "early"):
            raise ValueError("delay_direction must be late or early")
        signed = value if delay_direction == "late" else -value
        weight = F.greatest(signed, F.lit(0.0)) * count
    elif metric.startswith("pct_"):
        weight = value / 100.0 * count
    elif metric in COUNT_METRICS:
        weight = value.cast("double")
    else:
        raise ValueError(f"no heat weight for {metric}")
    located = metrics.filter(F.col("stop_lat").isNotNull() & F.col("stop_lon").isNotNull())
    return located.withColumn("heat_weight", weight).filter(F.col("heat_weight") > 0)


def positive_quantile(df: DataFrame, value: Column, quantile: float) -> Column:
    """Exact quantile of the positive values, as a scalar subquery."""
    positive = F.when(value > 0, value)
    return df.agg(F.percentile(positive, quantile)).scalar()


def heat_scale(
    weights: DataFrame,
    *,
    cap_quantile: float | None = HEAT_CAP_QUANTILE,
    manual_cap: float | None = None,
    cutoff_quantile: float | None = None,
    response: str = "linear",
) -> DataFrame:
    """Add the response-shaped weight, the intensity cap and the cutoff.

    `weights` has one row per stop; pass a written table so that the scalar
    subqueries read it instead of recomputing it.
    """
    weight = F.greatest(F.col("heat_weight"), F.lit(0.0))
    shapes = {"linear": weight, "sqrt": F.sqrt(weight), "log1p": F.log1p(weight)}
    if response not in shapes:
        raise ValueError(f"no heat response {response}")
    if cap_quantile is not None and not 0 < cap_quantile <= 1:
        raise ValueError("cap_quantile must lie in (0, 1]")
    if cutoff_quantile is not None and not 0 < cutoff_quantile < 1:
        raise ValueError("cutoff_quantile must lie in (0, 1)")
    shaped = weights.withColumn("shaped_weight", shapes[response])
    value = F.col("shaped_weight")
    if manual_cap is not None:
        cap = F.lit(float(manual_cap)) if manual_cap > 0 else F.lit(None).cast("double")
    else:
        cap = positive_quantile(shaped, value, 1.0 if cap_quantile is None else cap_quantile)
    cutoff = F.lit(None).cast("double")
    if cutoff_quantile is not None:
        cutoff = positive_quantile(shaped, value, cutoff_quantile)
    return shaped.withColumns({"intensity_max": cap, "intensity_cutoff": cutoff})


def colour_extent(df: DataFrame, value: str, manual_extent: float | None = None, automatic: bool = True) -> Column:
    """Half-width of a symmetric colour scale; 1 when nothing is off schedule."""
    if not automatic:
        return F.lit(float(manual_extent) if manual_extent is not None and manual_extent > 0 else 1.0)
    return F.coalesce(positive_quantile(df, F.abs(F.col(value)), COLOUR_QUANTILE), F.lit(1.0))


def marker_sizes(df: DataFrame, count: str = "bucket_count", sizes: tuple[float, float] = MARKER_SIZES) -> DataFrame:
    """Square-root scaled marker size between the two bounds; their mean if all counts agree."""
    root = F.sqrt(F.greatest(F.coalesce(F.col(count), F.lit(0)), F.lit(0)).cast("double"))
    span = df.agg(F.struct(F.min(root).alias("low"), F.max(root).alias("high"))).scalar()
    low, high = span.getField("low"), span.getField("high")
    small, large = sizes
    scaled = F.lit(small) + (root - low) / (high - low) * (large - small)
    return df.withColumn("marker_size", F.when(low == high, F.lit((small + large) / 2)).otherwise(scaled))
