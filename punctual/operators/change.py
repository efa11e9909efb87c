"""Before/after comparison on matched contexts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from punctual.functions.times import boundary, ceil_second, representative_time, second_text
from punctual.operators.metrics import SEEN, delay_histogram, earliest, metric_aggregates, metric_outputs
from punctual.operators.quality import is_analysis_row
from punctual.operators.stops import with_city_part, with_stop_metadata
from punctual.schemas import DEFAULT_TIMEZONE

CONTEXT = ["line_ref", "direction_ref", "local_weekday", "local_hour"]


@dataclass(frozen=True)
class Periods:
    """Two half-open periods."""

    baseline_start: datetime
    baseline_end: datetime
    comparison_start: datetime
    comparison_end: datetime

    @property
    def window(self) -> tuple[datetime, datetime]:
        return (
            min(self.baseline_start, self.comparison_start),
            max(self.baseline_end, self.comparison_end),
        )

    def label(self, time: str = "representative_time_utc") -> Column:
        """Period of a row; a time in both counts as comparison."""
        at = F.col(time)
        comparison = (at >= F.lit(self.comparison_start)) & (at < F.lit(self.comparison_end))
        baseline = (at >= F.lit(self.baseline_start)) & (at < F.lit(self.baseline_end))
        return F.when(comparison, "comparison").when(baseline, "baseline")


def explicit_periods(
    baseline_start, baseline_end, comparison_start, comparison_end, timezone: str = DEFAULT_TIMEZONE
) -> Periods:
    values = (baseline_start, baseline_end, comparison_start, comparison_end)
    if not all(values):
        raise ValueError("a comparison needs all four period bounds")
    periods = Periods(*[boundary(v, timezone) for v in values])
    if periods.baseline_start >= periods.baseline_end:
        raise ValueError("the baseline period must start before it ends")
    if periods.comparison_start >= periods.comparison_end:
        raise ValueError("the comparison period must start before it ends")
    return periods


def recent_periods(
    observations: DataFrame, period_days: int = 1, timezone: str = DEFAULT_TIMEZONE
) -> Periods | None:
    """The last `period_days` up to just after the newest stop call, and as many before.

    One maximum comes back to the driver; days are whole spans of 24 hours.
    """
    if period_days <= 0:
        raise ValueError("period_days must be positive")
    at_stop = observations.filter(is_analysis_row() & F.col("next_stop_point_ref").isNotNull())
    latest = at_stop.agg(F.unix_micros(F.max(representative_time())).alias("at")).first()["at"]
    if latest is None:
        return None
    end = ceil_second(from_micros(latest)) + timedelta(seconds=1)
    span = timedelta(days=period_days)
    return Periods(end - 2 * span, end - span, end - span, end)


def from_micros(micros: int) -> datetime:
    return boundary(datetime.fromisoformat("1970-01-01T00:00:00+00:00") + timedelta(microseconds=micros))


def midpoint_bounds(buckets: DataFrame) -> DataFrame:
    """First, middle and last whole millisecond of the buckets at a stop, one row."""
    at = F.unix_millis("representative_time_utc")
    at_stop = buckets.filter(F.col("next_stop_point_ref").isNotNull())
    return at_stop.agg(F.min(at).alias("start_ms"), F.max(at).alias("end_ms")).select(
        "start_ms",
        (F.col("start_ms") + F.expr("(end_ms - start_ms) div 2")).alias("middle_ms"),
        "end_ms",
    )


def midpoint_summary(buckets: DataFrame) -> DataFrame:
    """The two halves as text; no row if there is no span to halve."""
    text = {name: second_text(F.timestamp_millis(f"{name}_ms")) for name in ("start", "middle", "end")}
    return (
        midpoint_bounds(buckets)
        .filter(F.col("start_ms") < F.col("end_ms"))
        .select(
            text["start"].alias("baseline_start_utc"),
            text["middle"].alias("baseline_end_utc"),
            text["middle"].alias("comparison_start_utc"),
            text["end"].alias("comparison_end_utc"),
        )
    )


def midpoint_label(buckets: DataFrame) -> Column:
    """Period by halves; one row of bounds is read, so pass a written bucket table."""
    start, middle, end = midpoint_bounds(buckets).first()
    if start is None or start == end:
        return F.lit(None).cast("string")
    at = F.unix_millis("representative_time_utc")
    return F.when((at >= start) & (at < middle), "baseline").when((at >= middle) & (at <= end), "comparison")


def matched_histogram(rows: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Histogram of the rows whose context occurs in both periods.

    The context is judged on the histogram, where even a hot one is bounded by
    its distinct delays, so neither a self-join nor a raw-row window is needed.
    """
    context = list(dict.fromkeys([*keys, *CONTEXT]))
    histogram = delay_histogram(rows.filter(F.col("period").isNotNull()), [*context, "period"], names)
    same_context = Window.partitionBy(*context)
    return (
        histogram.withColumn("_both", F.min("period").over(same_context) < F.max("period").over(same_context))
        .filter("_both")
        .drop("_both")
    )


COMPARED = (
    "bucket_count",
    "raw_poll_count",
    "median_delay_min",
    "p90_delay_min",
    "pct_over_5_min_late",
    "pct_over_3_min_early",
)
CHANGES = {
    "median_delay_min": "median_delay_change_min",
    "p90_delay_min": "p90_delay_change_min",
    "pct_over_5_min_late": "over_5_min_late_pct_point_change",
}


def period_change(
    rows: DataFrame,
    keys: Sequence[str],
    *,
    names: Sequence[str] = (),
    min_observations: int = 1,
    limit: int | None = 20,
    sort_by: str = "absolute",
    prefer: str = "baseline",
) -> DataFrame:
    """Baseline and comparison metrics side by side for each key, with their changes.

    `rows` carry a `period` label. Names come from the `prefer`red period first.
    """
    orders = {
        "increase": F.desc("p90_delay_change_min"),
        "decrease": F.asc("p90_delay_change_min"),
        "absolute": F.desc(F.abs("p90_delay_change_min")),
    }
    if sort_by not in orders:
        raise ValueError(f"sort_by must be one of {', '.join(orders)}")
    aggregates = [a.alias(name) for name, a in metric_aggregates().items()]
    aggregates += [earliest(name, SEEN).alias(f"_first_{name}") for name in names]
    per_period = (
        matched_histogram(rows, keys, names)
        .groupBy(*keys, "period")
        .agg(*aggregates)
        .filter(F.col("bucket_count") >= min_observations)
        .select(*keys, "period", *[F.col(f"_first_{n}").alias(n) for n in names], *metric_outputs())
    )

    def of(period: str, column: str) -> Column:
        return F.max(F.when(F.col("period") == period, F.col(column)))

    other = "comparison" if prefer == "baseline" else "baseline"
    paired = per_period.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_periods"),
        *[F.coalesce(of(prefer, n), of(other, n)).alias(n) for n in names],
        *[of(p, c).alias(f"{p}_{c}") for p in ("baseline", "comparison") for c in COMPARED],
    )
    changed = paired.filter("_periods = 2").withColumns(
        {out: F.col(f"comparison_{c}") - F.col(f"baseline_{c}") for c, out in CHANGES.items()}
    )
    ordered = []
    for column in COMPARED:
        ordered += [f"baseline_{column}", f"comparison_{column}"]
        ordered += [CHANGES[column]] if column in CHANGES else []
    result = changed.orderBy(orders[sort_by], F.desc("comparison_bucket_count"), *keys).select(*keys, *names, *ordered)
    return result.limit(limit) if limit is not None else result


def midpoint_change(buckets: DataFrame, min_observations: int = 1, limit: int | None = 20) -> DataFrame:
    """Stops compared between the two halves of the data, by their reported names."""
    rows = buckets.filter(F.col("next_stop_point_ref").isNotNull()).select(
        "*",
        F.col("next_stop_point_ref").alias("stop_id"),
        F.col("next_stop_point_name").alias("stop_name"),
        midpoint_label(buckets).alias("period"),
    )
    return period_change(
        rows,
        ["stop_id"],
        names=["stop_name"],
        min_observations=min_observations,
        limit=limit,
        prefer="comparison",
    )


def stop_change(
    buckets: DataFrame,
    period: Column,
    *,
    stops: DataFrame | None = None,
    city_parts: DataFrame | None = None,
    group_by: str = "stop",
    min_observations: int = 1,
    limit: int | None = 20,
    sort_by: str = "absolute",
) -> DataFrame:
    """Stops or city parts compared between two labelled periods."""
    if group_by == "city-part" and city_parts is None:
        raise ValueError("grouping by city part needs a city part mapping")
    rows = with_city_part(with_stop_metadata(buckets.withColumn("period", period), stops), city_parts)
    if group_by == "city-part":
        rows = rows.filter(F.col("city_part").isNotNull())
        keys, names = ["city_part"], ["stop_name", "stop_lat", "stop_lon"]
    else:
        keys, names = ["stop_id"], ["stop_name", "city_part", "stop_lat", "stop_lon"]
    return period_change(
        rows, keys, names=names, min_observations=min_observations, limit=limit, sort_by=sort_by
    )
