"""Delay during service alerts against matched controls.

A group is (cause, effect, priority, scope). Its active buckets are those on an
alerted line or at an alerted stop while the alert holds; its controls are the
other buckets of the same line, direction, hour and day type.

Alert intervals are merged per group and target and cut into day cells, so a
bucket meets a group at most once and probes only the cells of its own target
and day. Controls are never listed: their histogram is that of the active
contexts minus that of the active buckets.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from punctual.functions.times import boundary, ceil_second, floor_second, representative_time
from punctual.functions.values import blank_to_unknown, json_scalars
from punctual.operators.change import from_micros
from punctual.operators.metrics import COUNT, DELAY, POLLS, delay_histogram, histogram_metrics
from punctual.operators.quality import is_analysis_row
from punctual.operators.rankings import LINE_NAME, top
from punctual.operators.stops import resolve_route_names
from punctual.schemas import ALERT_SCHEMA, DEFAULT_TIMEZONE, conform
from punctual.session import materialise

GROUP = ["cause", "effect", "priority", "alert_scope"]
CONTEXT = ["line_ref", "direction_ref", "local_hour", "day_type"]
ALERT_KINDS = ("any", "route", "stop")
DEFAULT_ANALYSIS_DAYS = 2


def analysis_window(
    observations: DataFrame,
    *,
    start=None,
    end=None,
    days: int = DEFAULT_ANALYSIS_DAYS,
    full_history: bool = False,
    line: str | None = None,
    timezone: str = DEFAULT_TIMEZONE,
) -> tuple[datetime | None, datetime | None]:
    """Explicit bounds, one bound and a length, or the latest days; (None, None) for all.

    Only the latest time is read, and only when no bound is given.
    """
    if full_history:
        return None, None
    if days <= 0:
        raise ValueError("days must be positive")
    span = timedelta(days=days)
    first = boundary(start, timezone) if start is not None else None
    last = boundary(end, timezone) if end is not None else None
    if first is None and last is None:
        rows = observations.filter(is_analysis_row())
        if line is not None:
            rows = rows.filter(F.col("line_ref") == line)
        latest = rows.agg(F.unix_micros(F.max(representative_time())).alias("at")).first()["at"]
        if latest is None:
            return None, None
        last = ceil_second(from_micros(latest)) + timedelta(seconds=1)
    first = first if first is not None else last - span
    last = last if last is not None else first + span
    if first >= last:
        raise ValueError("the analysis window must start before it ends")
    return first, last


def active_alerts(alerts: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Active alerts that overlap the window."""
    active = conform(alerts, ALERT_SCHEMA).filter(F.col("is_active") == 1)
    if end is not None:
        begins = F.coalesce("validity_start_utc", "created_at_utc")
        active = active.filter(begins < F.lit(ceil_second(end)))
    if start is not None:
        ends = F.col("validity_end_utc")
        active = active.filter(ends.isNull() | (ends >= F.lit(floor_second(start))))
    return active


def observation_bounds(buckets: DataFrame) -> tuple[Column, Column]:
    """First and last bucket time, found by the query that uses them; no job of its own."""
    at = "representative_time_utc"
    span = buckets.agg(F.struct(F.min(at).alias("first"), F.max(at).alias("last"))).scalar()
    return span.getField("first"), span.getField("last")


def alert_targets(
    alerts: DataFrame,
    routes: DataFrame | None,
    observed_from: Column,
    observed_to: Column,
    *,
    kind: str = "any",
    timezone: str = DEFAULT_TIMEZONE,
) -> DataFrame:
    """Distinct (group, target, start, end): an alert's own line, its routes, its stops."""
    if kind not in ALERT_KINDS:
        raise ValueError(f"kind must be one of {', '.join(ALERT_KINDS)}")
    timed = alerts.select(
        blank_to_unknown("cause").alias("cause"),
        blank_to_unknown("effect").alias("effect"),
        F.coalesce("priority", F.lit(-1)).alias("priority"),
        F.coalesce("validity_start_utc", "created_at_utc", observed_from).alias("start_utc"),
        F.coalesce(
            "validity_end_utc", observed_to + F.make_dt_interval(secs=F.lit(0.000001))
        ).alias("end_utc"),
        "line_ref",
        "affected_routes_json",
        "affected_stops_json",
    )
    base = ["cause", "effect", "priority", "start_utc", "end_utc"]
    parts = []
    if kind in ("any", "route"):
        own = timed.filter(F.col("line_ref").isNotNull()).select(
            *base, F.lit("route").alias("alert_scope"), F.col("line_ref").alias("target_ref")
        )
        listed = json_scalars(timed.select(*base, "affected_routes_json"), "affected_routes_json", "route_ref")
        named = resolve_route_names(listed, routes, timezone=timezone)
        parts += [own, named.select(*base, F.lit("route").alias("alert_scope"), "target_ref")]
    if kind in ("any", "stop"):
        at_stop = json_scalars(timed.select(*base, "affected_stops_json"), "affected_stops_json", "target_ref")
        parts.append(at_stop.select(*base, F.lit("stop").alias("alert_scope"), "target_ref"))
    targets = parts[0]
    for part in parts[1:]:
        targets = targets.unionByName(part)
    return targets.select(*GROUP, "target_ref", "start_utc", "end_utc").distinct()


def merged(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint (keys, start, end) islands of overlapping or touching intervals."""
    longest = intervals.groupBy(*keys, "start_utc").agg(F.max("end_utc").alias("end_utc"))
    in_order = Window.partitionBy(*keys).orderBy("start_utc")
    reached = F.max("end_utc").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("start_utc") > F.col("_reached"), F.lit(True))
    islands = longest.withColumn("_reached", reached).withColumn(
        "_island", F.sum(opens.cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return islands.groupBy(*keys, "_island").agg(
        F.min("start_utc").alias("start_utc"), F.max("end_utc").alias("end_utc")
    ).drop("_island")


def day_cells(
    targets: DataFrame, observed_from: Column, observed_to: Column, timezone: str = DEFAULT_TIMEZONE
) -> DataFrame:
    """Disjoint (group, target, local day, start, end) pieces of the alert intervals.

    Intervals are clipped to the observed time and merged before they are cut
    into days: first among those that start on the same day, then over all that
    is left of a target, which is at most a few islands for each day.
    """
    key = [*GROUP, "target_ref"]

    def local_day(time: str) -> Column:
        return F.to_date(F.from_utc_timestamp(time, timezone))

    def midnight(day: Column) -> Column:
        return F.to_utc_timestamp(day.cast("timestamp"), timezone)

    clipped = targets.select(
        *key,
        F.greatest("start_utc", observed_from).alias("start_utc"),
        F.least("end_utc", observed_to).alias("end_utc"),
    ).filter(F.col("start_utc") <= F.col("end_utc"))
    by_day = merged(clipped.withColumn("_starts", local_day("start_utc")), [*key, "_starts"])
    islands = merged(by_day, key)
    day = F.col("day")
    return islands.withColumn("day", F.explode(F.sequence(local_day("start_utc"), local_day("end_utc")))).select(
        *key,
        "day",
        F.greatest(F.col("start_utc"), midnight(day)).alias("start_utc"),
        F.least(F.col("end_utc"), midnight(F.date_add(day, 1))).alias("end_utc"),
    )


def alert_span(cells: DataFrame) -> Column:
    """Whether a bucket lies between the first and the last alerted moment, by day and by time.

    Read from written cells when the buckets are scanned: days outside the span are never opened.
    """
    at, day = F.col("representative_time_utc"), F.col("local_date")
    bounds = {"first": F.min("day"), "last": F.max("day"), "low": F.min("start_utc"), "high": F.max("end_utc")}
    span = cells.agg(F.struct(*[bound.alias(name) for name, bound in bounds.items()])).scalar()
    within_days = (day >= span.getField("first")) & (day <= span.getField("last"))
    return within_days & (at >= span.getField("low")) & (at <= span.getField("high"))


def active_buckets(buckets: DataFrame, cells: DataFrame) -> DataFrame:
    """Each bucket once per group whose alert covers it, through its line or its stop.

    Both scopes are keys of one equality join on (scope, target, local day).
    Pass written cells: the size of their files then decides between a broadcast
    and a merge. Buckets outside the alerted span are dropped before they are
    doubled, and of buckets with a folder per local day a broadcast opens the
    alerted days alone.
    """
    at = F.col("representative_time_utc")
    keyed = buckets.filter(alert_span(cells)).select(
        *CONTEXT,
        "published_line_name",
        DELAY,
        POLLS,
        "representative_time_utc",
        F.col("local_date").alias("day"),
        F.explode(
            F.array(
                F.struct(F.lit("route").alias("alert_scope"), F.col("line_ref").alias("target_ref")),
                F.struct(F.lit("stop").alias("alert_scope"), F.col("next_stop_point_ref").alias("target_ref")),
            )
        ).alias("_target"),
    ).select("*", "_target.*").filter(F.col("target_ref").isNotNull())
    # The optimizer derives a filter on the days from a side only if that side is itself filtered.
    joined = keyed.join(cells.filter(F.col("start_utc") <= F.col("end_utc")), ["alert_scope", "target_ref", "day"])
    # Adjacent cells share midnight itself, so the day of the bucket decides.
    return joined.filter((at >= F.col("start_utc")) & (at <= F.col("end_utc")))


def active_histogram(buckets: DataFrame, cells: DataFrame) -> DataFrame:
    return delay_histogram(active_buckets(buckets, cells), [*GROUP, *CONTEXT], ["published_line_name"])


def control_histogram(buckets: DataFrame, active: DataFrame) -> DataFrame:
    """Controls per (group, line, delay): active contexts less the active buckets."""
    whole = delay_histogram(buckets, CONTEXT)
    contexts = active.select(*GROUP, *CONTEXT).distinct()
    keep = [*GROUP, "line_ref", DELAY, COUNT, POLLS]
    total = contexts.join(whole, CONTEXT).select(*keep)
    taken = active.select(*GROUP, "line_ref", DELAY, (-F.col(COUNT)).alias(COUNT), (-F.col(POLLS)).alias(POLLS))
    return (
        total.unionByName(taken)
        .groupBy(*GROUP, "line_ref", DELAY)
        .agg(F.sum(COUNT).alias(COUNT), F.sum(POLLS).alias(POLLS))
        .filter(F.col(COUNT) > 0)
    )


COMPARED = ("bucket_count", "raw_poll_count", "median_delay_min", "p90_delay_min", "pct_over_5_min_late", "pct_over_3_min_early")
LIFTS = {
    "median_delay_min": "median_delay_lift_min",
    "p90_delay_min": "p90_delay_lift_min",
    "pct_over_5_min_late": "over_5_min_late_pct_point_lift",
}


def alert_lift(
    active: DataFrame,
    controls: DataFrame,
    *,
    by_line: bool = False,
    min_observations: int = 1,
    limit: int | None = 20,
) -> DataFrame:
    """Alert and control metrics per group, or per group and line, with their differences."""
    keys = [*GROUP, "line_ref"] if by_line else GROUP
    names = ["line_name"] if by_line else []
    alert = histogram_metrics(
        active, keys, min_observations=min_observations, first=LINE_NAME if by_line else None
    )
    control = histogram_metrics(controls, keys, min_observations=min_observations)
    paired = alert.select(*keys, *names, *[F.col(c).alias(f"{c}_alert") for c in COMPARED]).join(
        control.select(*keys, *[F.col(c).alias(f"{c}_control") for c in COMPARED]), keys
    )
    lifted = paired.withColumns({out: F.col(f"{c}_alert") - F.col(f"{c}_control") for c, out in LIFTS.items()})
    columns = [*keys, *names]
    for column in COMPARED:
        columns += [f"{column}_control", f"{column}_alert"]
        columns += [LIFTS[column]] if column in LIFTS else []
    return top(
        lifted, ("p90_delay_lift_min", "over_5_min_late_pct_point_lift", "bucket_count_alert"), keys, limit
    ).select(*columns)


def alert_active(
    buckets: DataFrame,
    alerts: DataFrame,
    routes: DataFrame | None,
    *,
    start: datetime | None = None,
    end: datetime | None = None,
    kind: str = "any",
    timezone: str = DEFAULT_TIMEZONE,
) -> DataFrame:
    """Active histogram of every group, from written buckets.

    Write it before comparing: metrics, contexts and controls each read it. The
    cells are written here.
    """
    bounds = observation_bounds(buckets)
    targets = alert_targets(active_alerts(alerts, start, end), routes, *bounds, kind=kind, timezone=timezone)
    return active_histogram(buckets, materialise(day_cells(targets, *bounds, timezone), "alert_cells"))
