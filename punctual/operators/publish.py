"""Publication tables: aggregates without identifiers, and selections over them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from punctual.functions.times import hour_label, minute_text
from punctual.functions.values import natural_key, round_doubles
from punctual.operators.metrics import delay_histogram, metric_aggregates, metric_outputs, summarize_delay_metrics
from punctual.operators.rankings import LINE_NAME

ALL = "all"
SCHEMA_VERSION = 1
MIN_BUCKETS = 30
# Identifiers that may not be published, under any nesting.
FORBIDDEN_KEYS = frozenset(
    {
        "vehicle_id",
        "trip_id",
        "trip_match_key",
        "bucket_id",
        "poll_id",
        "source_alert_id",
        "recorded_at_utc",
        "representative_time_utc",
    }
)
STOP_METRIC_COLUMNS = (
    "bucket_count",
    "raw_poll_count",
    "signed_mean_delay_min",
    "median_delay_min",
    "p90_delay_min",
    "pct_over_5_min_late",
    "pct_over_3_min_early",
    "p90_early_min_abs",
)


def public_lines(buckets: DataFrame, min_buckets: int = MIN_BUCKETS) -> DataFrame:
    return summarize_delay_metrics(
        buckets, ["line_ref"], min_observations=min_buckets, first=LINE_NAME
    ).orderBy("line_ref")


def public_contexts(buckets: DataFrame, min_buckets: int = MIN_BUCKETS) -> DataFrame:
    keys = ["line_ref", "direction_ref", "day_type", "local_hour"]
    return summarize_delay_metrics(buckets, keys, min_observations=min_buckets, first=LINE_NAME).orderBy(*keys)


def public_stop_metrics(buckets: DataFrame, min_buckets: int = MIN_BUCKETS) -> DataFrame:
    """Metrics per stop, by line, by day type and by both; `all` marks an open dimension.

    The four groupings expand the histogram, not the buckets.
    """
    at_stop = buckets.filter(F.col("next_stop_point_ref").isNotNull()).withColumn(
        "stop_id", F.col("next_stop_point_ref")
    )
    histogram = delay_histogram(at_stop, ["stop_id", "line_ref", "day_type"])
    grouped = histogram.groupingSets(
        [["stop_id"], ["stop_id", "day_type"], ["stop_id", "line_ref"], ["stop_id", "line_ref", "day_type"]],
        "stop_id",
        "line_ref",
        "day_type",
    ).agg(
        F.grouping("line_ref").alias("_any_line"),
        F.grouping("day_type").alias("_any_day"),
        *[a.alias(name) for name, a in metric_aggregates().items()],
    )
    labelled = grouped.filter(F.col("bucket_count") >= min_buckets).select(
        "stop_id",
        F.when(F.col("_any_line") == 1, ALL).otherwise(F.col("line_ref")).alias("line_ref"),
        F.when(F.col("_any_day") == 1, ALL).otherwise(F.col("day_type")).alias("day_type"),
        *metric_outputs(),
    )
    return labelled.select("stop_id", "line_ref", "day_type", *STOP_METRIC_COLUMNS).orderBy(
        "stop_id", "line_ref", "day_type"
    )


def newest_stops(stops: DataFrame) -> DataFrame:
    """The newest feed's row of each stop."""
    values = ["gtfs_stop_name", "stop_lat", "stop_lon"]
    feed = F.col("gtfs_feed_date") if "gtfs_feed_date" in stops.columns else F.lit(None).cast("date")
    return (
        stops.groupBy("stop_id")
        .agg(F.max_by(F.struct(*values), F.struct(feed.alias("feed"), *values)).alias("newest"))
        .select(
            "stop_id", F.col("newest.gtfs_stop_name").alias("stop_name"), "newest.stop_lat", "newest.stop_lon"
        )
    )


def canonical_stops(stops: DataFrame | None, buckets: DataFrame) -> DataFrame:
    """One row per observed stop: newest metadata, else the last reported name, else the id."""
    per_name = (
        buckets.filter(F.col("next_stop_point_ref").isNotNull())
        .groupBy(F.col("next_stop_point_ref").alias("stop_id"), "line_ref", "next_stop_point_name")
        .agg(F.max("representative_time_utc").alias("seen"))
    )
    name = F.col("next_stop_point_name")
    observed = per_name.groupBy("stop_id").agg(
        F.max_by(name, F.when(name.isNotNull(), F.struct("seen", name))).alias("fallback_name"),
        F.count_distinct("line_ref").alias("line_count"),
    )
    if stops is None:
        located = observed.withColumns(
            {
                "stop_name": F.lit(None).cast("string"),
                "stop_lat": F.lit(None).cast("double"),
                "stop_lon": F.lit(None).cast("double"),
            }
        )
    else:
        located = observed.join(newest_stops(stops), "stop_id", "left")
    return located.select(
        "stop_id",
        F.coalesce("stop_name", "fallback_name", "stop_id").alias("stop_name"),
        "stop_lat",
        "stop_lon",
        "line_count",
    ).orderBy("stop_id")


def published_stops(canonical: DataFrame, metrics: DataFrame) -> DataFrame:
    """Canonical stops that have at least one published metric."""
    return canonical.join(metrics.select("stop_id").distinct(), "stop_id", "left_semi")


def daily_histogram(buckets: DataFrame) -> DataFrame:
    """What the overview needs of the buckets; write it, as the overview reads it twice."""
    return delay_histogram(buckets, ["line_ref", "next_stop_point_ref", "local_date"])


def overview(buckets: DataFrame, min_buckets: int = MIN_BUCKETS) -> DataFrame:
    """Overall metrics with line and stop counts and the date span, one row."""
    metrics = summarize_delay_metrics(
        buckets,
        [],
        min_observations=min_buckets,
        distinct={"line_count": "line_ref", "stop_count": "next_stop_point_ref"},
    )
    span = buckets.agg(F.struct(F.min("local_date").alias("first"), F.max("local_date").alias("last"))).scalar()
    return metrics.select("*", span.getField("first").alias("start_date"), span.getField("last").alias("end_date"))


def takeaways(late: DataFrame, early: DataFrame, hourly: DataFrame, rush: DataFrame) -> DataFrame:
    """The rows behind the headline sentences: (id, subject, value)."""
    peak = hourly.orderBy(F.desc("p90_delay_min"), F.desc("pct_over_5_min_late"), "hour_local").limit(1)

    def row(df: DataFrame, name: str, subject: str, value: str) -> DataFrame:
        return df.limit(1).select(F.lit(name).alias("id"), F.col(subject).alias("subject"), F.col(value).alias("value"))

    rows = [
        row(late, "late-lines", "line_name", "p90_delay_min"),
        row(early, "early-lines", "line_name", "pct_over_3_min_early"),
        row(peak, "peak-hour", "hour_local", "p90_delay_min"),
        row(rush, "rush-effect", "line_name", "rush_p90_delay_lift_min"),
    ]
    result = rows[0]
    for other in rows[1:]:
        result = result.unionByName(other)
    return result


def public_gaps(spots: DataFrame) -> DataFrame:
    """Collector gaps with their times cut to the minute."""
    times = {c: minute_text(F.try_to_timestamp(F.col(c))) for c in ("gap_start_utc", "gap_end_utc")}
    return spots.withColumns(times)


def field_names(schema: T.DataType) -> Iterable[str]:
    if isinstance(schema, T.StructType):
        for field in schema.fields:
            yield field.name
            yield from field_names(field.dataType)
    elif isinstance(schema, T.ArrayType):
        yield from field_names(schema.elementType)
    elif isinstance(schema, T.MapType):
        yield from field_names(schema.valueType)


def check_fields(name: str, schema: T.StructType, required: Iterable[str] = ()) -> None:
    """Raise if the names of a published table break the contract, at any depth."""
    if "schema_version" not in schema.names:
        raise ValueError(f"{name}: no schema version")
    forbidden = sorted(FORBIDDEN_KEYS & set(field_names(schema)))
    if forbidden:
        raise ValueError(f"{name}: forbidden public keys: {', '.join(forbidden)}")
    missing = sorted(set(required) - set(schema.names))
    if missing:
        raise ValueError(f"{name}: missing required columns: {', '.join(missing)}")


def contract_counts(schema: T.StructType, local_paths: Iterable[str] = ()) -> dict[str, Column]:
    """Aggregates: rows, and rows of another schema version, with a non-finite number, with a local path."""
    endless, located = [], []
    for field in schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            endless.append(F.isnan(column) | (F.abs(column) == float("inf")))
        elif isinstance(field.dataType, T.StringType):
            located += [column.contains(path) for path in local_paths]
        elif isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            endless.append(F.to_json(column).rlike(r'"(NaN|-?Infinity)"|:(NaN|-?Infinity)\b'))
            located += [F.to_json(column).contains(path) for path in local_paths]

    def rows_with(conditions: list[Column]) -> Column:
        return F.count_if(reduce(lambda one, other: one | other, conditions, F.lit(False)))

    return {
        "row_count": F.count(F.lit(1)),
        "other_version_rows": F.count_if(~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION))),
        "non_finite_rows": rows_with(endless),
        "local_path_rows": rows_with(located),
    }


def check_counts(name: str, counts: Mapping[str, int]) -> None:
    """Raise if the counts of `contract_counts` tell of rows that must not be published."""
    if counts["other_version_rows"]:
        raise ValueError(f"{name}: unsupported schema version")
    if counts["non_finite_rows"] or counts["local_path_rows"]:
        raise ValueError(f"{name}: non-finite numbers or local paths must not be published")


def validate_public(name: str, df: DataFrame, required: Iterable[str] = (), local_paths: Iterable[str] = ()) -> None:
    """Raise if a table breaks the publication contract; `sinks.write_json` checks while it writes."""
    check_fields(name, df.schema, required)
    counts = contract_counts(df.schema, local_paths)
    check_counts(name, df.agg(*[c.alias(n) for n, c in counts.items()]).first().asDict())


def line_documents(lines: DataFrame, contexts: DataFrame, digits: int = 2) -> DataFrame:
    """One nested record per line: its metrics and, in order, its contexts.

    A line has at most two day types and 24 hours for each direction. Numbers
    within the contexts are rounded here, as sinks round columns only.
    """
    keys = ["direction_ref", "day_type", "local_hour"]
    values = sorted(c for c in contexts.columns if c not in (*keys, "line_ref", "line_name"))
    rounded = round_doubles(contexts, digits)
    listed = rounded.groupBy("line_ref").agg(F.sort_array(F.collect_list(F.struct(*keys, *values))).alias("contexts"))
    return lines.join(listed, "line_ref", "left")


# Columns each published table must carry.
REQUIRED = {
    "meta": ("schema_version", "timezone", "bucket_mode", "quality_mode", "minimum_bucket_count"),
    "summary": ("bucket_count", "line_count", "stop_count", "median_delay_min", "p90_delay_min", "pct_over_5_min_late"),
    "hourly_profile": ("local_hour", "bucket_count", "p90_delay_min"),
    "takeaways": ("id", "subject", "value"),
    "lines": ("line_ref", "line_name", "bucket_count", "p90_delay_min"),
    "contexts": ("line_ref", "direction_ref", "day_type", "local_hour", "p90_delay_min"),
    "stops": ("stop_id", "stop_name", "line_count"),
    "stop_metrics": ("stop_id", "line_ref", "day_type", "bucket_count", "p90_delay_min"),
    "rush_impact": ("line_ref", "rush_p90_delay_lift_min"),
    "alerts": (
        "cause",
        "effect",
        "priority",
        "alert_scope",
        "bucket_count_control",
        "bucket_count_alert",
        "median_delay_lift_min",
        "p90_delay_lift_min",
        "over_5_min_late_pct_point_lift",
    ),
    "quality": ("quality_check", "row_count", "pct_rows"),
    "collector_gaps": (
        "source",
        "gap_start_utc",
        "gap_end_utc",
        "gap_min",
        "missing_min",
        "estimated_missed_polls",
    ),
    "stop_changes": (
        "stop_id",
        "stop_name",
        "baseline_bucket_count",
        "comparison_bucket_count",
        "median_delay_change_min",
        "p90_delay_change_min",
        "over_5_min_late_pct_point_change",
    ),
}


def explorable_lines(lines: DataFrame, contexts: DataFrame) -> DataFrame:
    """Lines with an hourly profile, in natural name order."""
    return lines.join(contexts.select("line_ref").distinct(), "line_ref", "left_semi").orderBy(
        natural_key("line_name"), "line_ref"
    )


def hour_range(first: int | None, last: int | None) -> tuple[int, int]:
    bounds = (0 if first is None else first, 23 if last is None else last)
    return min(bounds), max(bounds)


def line_contexts(
    contexts: DataFrame, line: str, direction: str, day_type: str, first: int | None = None, last: int | None = None
) -> DataFrame:
    start, end = hour_range(first, last)
    return contexts.filter(
        (F.col("line_ref") == line)
        & (F.col("direction_ref") == direction)
        & (F.col("day_type") == day_type)
        & F.col("local_hour").between(start, end)
    ).orderBy("local_hour")


def default_line(contexts: DataFrame, direction: str, day_type: str) -> DataFrame:
    """The line covering most hours, then most buckets, then first by name."""
    return (
        contexts.filter((F.col("direction_ref") == direction) & (F.col("day_type") == day_type))
        .groupBy("line_ref")
        .agg(F.count_distinct("local_hour").alias("hours"), F.sum("bucket_count").alias("buckets"))
        .orderBy(F.desc("hours"), F.desc("buckets"), natural_key("line_ref"), "line_ref")
        .limit(1)
    )


def stop_points(
    stops: DataFrame, metrics: DataFrame, *, line: str = ALL, day_type: str = ALL, mode: str = "late", query: str = ""
) -> DataFrame:
    """Stops of a selection that match the text, strongest first."""
    display = "p90_delay_min" if mode == "late" else "p90_early_min_abs"
    chosen = metrics.filter((F.col("line_ref") == line) & (F.col("day_type") == day_type))
    points = chosen.join(stops, "stop_id").withColumn("display_value", F.col(display))
    if query:
        wanted = F.lower(F.lit(query))
        points = points.filter(
            F.lower("stop_id").contains(wanted) | F.lower("stop_name").contains(wanted)
        )
    return points.orderBy(F.desc("display_value"), F.desc("bucket_count"), "stop_id")


def public_hours(buckets: DataFrame, min_buckets: int = MIN_BUCKETS) -> DataFrame:
    """Hourly profile keyed by the hour number, with its label."""
    hours = summarize_delay_metrics(buckets, ["local_hour"], min_observations=min_buckets)
    return hours.withColumn("hour_local", hour_label()).orderBy("local_hour")
