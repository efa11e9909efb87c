"""Every operator as a query over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, time

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from punctual.functions.values import json_scalars
from punctual.operators import alerts, buckets, change, collector, dashboard, publish, quality, rankings, selection, stops
from punctual.operators.metrics import delay_histogram
from punctual.plans.adapter import FEEDS, polls_with_gaps, tables
from punctual.plans.replay import Replay, new_folder
from punctual.plans.tables import Tables
from punctual.session import application_folder, materialise
from punctual.sources import gtfs
from punctual.sources.colocated import write_colocated, write_poll_times
from punctual.sources.readers import read_result, source_summary
from punctual.sources.sinks import labelled_union, write_csv, write_csv_file, write_json, write_tables
from punctual.streaming import polls as streams

MIN = 5
LIMIT = 20
# The data have 12 lines, 8 stops and 5 city parts: these limits cut, so that the order decides what stays.
TOP, TOP_PARTS = 5, 3

#: The cadence that the alarms on a stream go by, as no median is known there.
CADENCE_SECONDS = 300.0

# The windows, lines and filters of the registered queries.
PERIODS = ("2024-01-02", "2024-01-12", "2024-01-12", "2024-01-22")
WINDOW = ("2024-01-10T06:00:00", "2024-01-24T18:00:00")
LINE = "L4"
THRESHOLDS = dict(
    max_abs_delay_seconds=600,
    stale_seconds=40,
    pre_trip_grace_seconds=60,
    post_trip_grace_seconds=120,
    stop_call_disagreement_seconds=30,
)
CALENDAR = dict(
    start_date=date(2024, 1, 5),
    end_date=date(2024, 1, 25),
    lines=["L1", "L4", "L6"],
    directions=["1", "2"],
    days="Weekdays",
    start_time=time(6, 30),
    end_time=time(18, 15),
)


def plain(df: DataFrame) -> DataFrame:
    """Result columns as whole numbers, text and doubles of six digits."""
    columns = []
    for field in df.schema.fields:
        column, kind = F.col(field.name), field.dataType
        if isinstance(kind, T.BooleanType):
            column = column.cast("int").cast("long")
        elif isinstance(kind, T.IntegralType):
            column = column.cast("long")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            column = F.round(column, 6) + F.lit(0.0)
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, T.DateType):
            column = column.cast("string")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def rows_of(t: Tables, **options) -> DataFrame:
    return quality.quality_rows(t.observations, t.polls, **options)


def buckets_of(t: Tables, bucket: str = "trip-stop") -> DataFrame:
    return buckets.delay_buckets(rows_of(t), bucket)


def written_buckets(t: Tables) -> DataFrame:
    """Trip-stop buckets as a table, for queries that read them more than once."""
    return materialise(buckets_of(t), "delay_buckets", by_day="local_date")


def windowed_buckets(t: Tables, **selection) -> DataFrame:
    return buckets.delay_buckets(quality.select_rows(rows_of(t), **selection))


def at_stop(t: Tables) -> DataFrame:
    return stops.with_stop_metadata(buckets_of(t), t.stops)


def quality_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id",
        "collected_at_utc",
        "observation_age_seconds",
        "validity_lag_seconds",
        "stop_call_delay_seconds",
        "stop_call_delay_diff_seconds",
        *quality.QUALITY_FLAGS,
        "quality_issue_count",
        "quality_pass",
    )


def quality_rows_colocated(t: Tables) -> DataFrame:
    """Quality of observations that are stored in the same buckets as their polls."""
    name = f"colocated_{uuid.uuid4().hex}"
    stored = write_colocated(t.observations, t.polls, f"{application_folder(t.polls.sparkSession)}/{name}", name)
    return quality_columns(quality.quality_rows(*stored))


def line_metrics_raw(t: Tables) -> DataFrame:
    """Metrics by line over every raw poll, whose delays may be any number."""
    polls = buckets.delay_buckets(rows_of(t, mode="raw"), "poll")
    counted = materialise(delay_histogram(polls, ["line_ref"], ["published_line_name"]), "raw_histogram")
    return selection.wide_metrics(counted, ["line_ref"], min_observations=MIN, first=rankings.LINE_NAME)


def bucket_modes(mode: str) -> Callable[[Tables], DataFrame]:
    return lambda t: buckets_of(t, mode)


def windowed(t: Tables) -> DataFrame:
    start, end = (change.boundary(v) for v in WINDOW)
    return windowed_buckets(t, start=start, end=end, line=LINE, has_stop=True)


def stop_metrics(t: Tables) -> DataFrame:
    return dashboard.stop_metrics(at_stop(t), MIN)


def stop_heat_scaled(t: Tables) -> DataFrame:
    weights = materialise(dashboard.heat_weights(stop_metrics(t), "p90_delay_min"), "stop_heat")
    scaled = dashboard.heat_scale(weights, cutoff_quantile=0.5, response="sqrt")
    keep = ["stop_id", "stop_name", "heat_weight", "shaped_weight", "intensity_max", "intensity_cutoff"]
    return scaled.select(*keep)


def stop_heat_shapes(t: Tables) -> DataFrame:
    """The other shapes and caps of the heat scale: linear, log1p, a manual cap and none."""
    weights = materialise(dashboard.heat_weights(stop_metrics(t), "p90_delay_min"), "stop_heat")
    shapes = {
        "linear": dashboard.heat_scale(weights),
        "log1p": dashboard.heat_scale(weights, response="log1p", cap_quantile=None),
        "manual": dashboard.heat_scale(weights, manual_cap=25.0),
    }
    keep = ["stop_id", "shaped_weight", "intensity_max", "intensity_cutoff"]
    return labelled_union({name: scaled.select(*keep) for name, scaled in shapes.items()}, "response")


def results_read_back(t: Tables) -> DataFrame:
    """Late lines written as a result table and read back by name."""
    spark = t.observations.sparkSession
    root = f"{application_folder(spark)}/results-{uuid.uuid4().hex}"
    write_tables({"line_late_rankings": rankings.late_lines(rankings.line_metrics(buckets_of(t), MIN), TOP)}, root)
    return read_result(spark, root, "line_late_rankings")


def csv_round_trip(t: Tables) -> DataFrame:
    """Both line rankings as labelled CSV, read back by the schema that was written."""
    metrics = materialise(rankings.line_metrics(buckets_of(t), MIN), "line_metrics")
    views = labelled_union({"late": rankings.late_lines(metrics, TOP), "early": rankings.early_lines(metrics, TOP)})
    path = f"{application_folder(t.observations.sparkSession)}/views-{uuid.uuid4().hex}"
    write_csv(views, path, digits=6)
    return views.sparkSession.read.schema(views.schema).csv(path, header=True)


def json_round_trip(t: Tables) -> DataFrame:
    """Published lines as JSON, with their schema version, read back."""
    path = f"{application_folder(t.observations.sparkSession)}/lines-{uuid.uuid4().hex}"
    lines = publish.public_lines(buckets_of(t), MIN)
    write_json(lines, path, name="lines/lines", required=publish.REQUIRED["lines"])
    schema = T.StructType([*lines.schema.fields, T.StructField("schema_version", T.LongType())])
    return t.observations.sparkSession.read.schema(schema).json(path)


def line_documents(t: Tables) -> DataFrame:
    """Lines published as nested records, read back whole, with a row for each context."""
    path = f"{application_folder(t.observations.sparkSession)}/documents-{uuid.uuid4().hex}"
    cube = materialise(rankings.delay_cube(buckets_of(t)), "delay_cube")
    documents = publish.line_documents(publish.public_lines(cube, MIN), publish.public_contexts(cube, MIN))
    write_json(documents, path, name="lines/documents", required=publish.REQUIRED["lines"])
    back = t.observations.sparkSession.read.schema(documents.schema).json(path)
    spread = back.select("line_ref", F.col("p90_delay_min").alias("line_p90_delay_min"), F.posexplode_outer("contexts"))
    return spread.select("line_ref", "line_p90_delay_min", F.col("pos").alias("position"), "col.*")


def publication_checks(t: Tables) -> DataFrame:
    """What the contract finds in the published lines and contexts, and in the same rows with faults."""
    cube = materialise(rankings.delay_cube(buckets_of(t)), "delay_cube")
    few = F.col("bucket_count") % 2 == 0
    faults = {
        "version": ("schema_version", F.when(few, publish.SCHEMA_VERSION + 1).otherwise(publish.SCHEMA_VERSION)),
        "number": ("p90_delay_min", F.when(few, float("nan")).otherwise(F.col("p90_delay_min"))),
        "path": ("line_name", F.when(few, F.concat(F.lit("/srv/data/"), "line_name")).otherwise(F.col("line_name"))),
    }
    views = {}
    for section, table in (("lines", publish.public_lines(cube, MIN)), ("contexts", publish.public_contexts(cube, MIN))):
        good = table.withColumn("schema_version", F.lit(publish.SCHEMA_VERSION))
        for fault, (column, value) in {"none": ("line_name", F.col("line_name")), **faults}.items():
            rows = good.withColumn(column, value)
            counts = publish.contract_counts(rows.schema, ["/srv/data/"])
            views[f"{section}, {fault}"] = rows.agg(*[c.alias(n) for n, c in counts.items()])
    return labelled_union(views, "check")


def written_feeds(t: Tables) -> str:
    """Stops, routes and city parts as timetable folders and a CSV file, below a folder of their own."""
    root = new_folder(t.observations, "feeds")
    for day, _ in FEEDS:
        for table, fields, name in ((t.stops, gtfs.STOP_FIELDS, "stops.txt"), (t.routes, gtfs.ROUTE_FIELDS, "routes.txt")):
            rows = table.where(F.col("gtfs_feed_date") == F.lit(day).cast("date"))
            rows = rows.withColumnRenamed("gtfs_stop_name", "stop_name").select(*fields)
            write_csv_file(rows, f"{root}/gtfs_{day}/{name}")
    write_csv_file(t.city_parts, f"{root}/city_parts.csv")
    return root


def feeds_read_back(t: Tables) -> DataFrame:
    """Feeds found, the latest of them, and all rows of their files and of the city parts."""
    spark, root = t.observations.sparkSession, written_feeds(t)
    nothing, no_name = F.lit(None).cast("double"), F.lit(None).cast("string")
    folder = F.substring_index("gtfs_dir", "/", -1)
    latest = gtfs.latest_feed(spark, root)
    views = {
        "feed": gtfs.discover_feeds(spark, root, "stops.txt").select("gtfs_feed_date", folder, no_name, nothing, nothing),
        "latest": gtfs.read_stops(spark, gtfs_dir=latest).select(
            F.lit(None).cast("date"), "stop_id", "gtfs_stop_name", "stop_lat", "stop_lon"
        ),
        "stop": gtfs.read_stops(spark, gtfs_root=root).select(
            "gtfs_feed_date", "stop_id", "gtfs_stop_name", "stop_lat", "stop_lon"
        ),
        "route": gtfs.read_routes(spark, gtfs_root=root).select(
            "gtfs_feed_date", "route_id", "route_short_name", nothing, nothing
        ),
        "part": gtfs.read_city_parts(spark, f"{root}/city_parts.csv").select(
            F.lit(None).cast("date"), "stop_id", "city_part", nothing, nothing
        ),
    }
    columns = ("gtfs_feed_date", "ref", "name", "lat", "lon")
    return labelled_union({kind: rows.toDF(*columns) for kind, rows in views.items()}, "kind")


def stops_asof_files(t: Tables) -> DataFrame:
    """Buckets with the metadata of their stop, from the feed files that held on their day."""
    found = gtfs.read_stops(t.observations.sparkSession, gtfs_root=written_feeds(t))
    return stops.with_stop_metadata(buckets_of(t), found).select(
        "bucket_id", "stop_id", "gtfs_feed_date", "stop_name", "stop_lat", "stop_lon", "has_gtfs_stop_metadata"
    )


def stop_markers(t: Tables) -> DataFrame:
    metrics = materialise(stop_metrics(t), "stop_metrics")
    sized = dashboard.marker_sizes(metrics)
    extent = dashboard.colour_extent(metrics, "median_delay_min")
    return sized.select("stop_id", "stop_name", "bucket_count", "marker_size", extent.alias("colour_extent"))


def filter_options(t: Tables) -> DataFrame:
    options = dashboard.filter_options(buckets_of(t))
    joined = {c: F.array_join(c, ",") for c in ("line_options", "direction_options")}
    return options.withColumns(joined)


def filtered(t: Tables) -> DataFrame:
    return dashboard.selection_summary(dashboard.filter_buckets(buckets_of(t), **CALENDAR))


def midpoint_change(t: Tables) -> DataFrame:
    return rankings.numbered(change.midpoint_change(written_buckets(t), MIN, TOP))


def changed(t: Tables, periods: change.Periods, limit: int = TOP, **options) -> DataFrame:
    start, end = periods.window
    selected = windowed_buckets(t, start=start, end=end, has_stop=True)
    found = change.stop_change(
        selected, periods.label(), stops=t.stops, city_parts=t.city_parts, min_observations=MIN, limit=limit, **options
    )
    return rankings.numbered(found)


def stop_change_explicit(t: Tables) -> DataFrame:
    return changed(t, change.explicit_periods(*PERIODS), sort_by="increase")


def stop_change_recent(t: Tables) -> DataFrame:
    return changed(t, change.recent_periods(t.observations, 7), sort_by="decrease")


def city_part_change(t: Tables) -> DataFrame:
    return changed(t, change.explicit_periods(*PERIODS), TOP_PARTS, group_by="city-part")


def alert_targets(t: Tables) -> DataFrame:
    bounds = alerts.observation_bounds(buckets_of(t))
    return alerts.alert_targets(alerts.active_alerts(t.alerts), t.routes, *bounds)


def lift(written: DataFrame, active: DataFrame, **options) -> DataFrame:
    active = materialise(active, "alert_active")
    return alerts.alert_lift(active, alerts.control_histogram(written, active), limit=LIMIT, **options)


def alert_lift(t: Tables, by_line: bool, kind: str = "any") -> DataFrame:
    written = written_buckets(t)
    active = alerts.alert_active(written, t.alerts, t.routes, kind=kind)
    return lift(written, active, by_line=by_line, min_observations=MIN)


def alert_recent_routes(t: Tables) -> DataFrame:
    """The latest two days only, route alerts only; the window precedes bucketing."""
    start, end = alerts.analysis_window(t.observations)
    recent = materialise(windowed_buckets(t, start=start, end=end), "recent_buckets", by_day="local_date")
    active = alerts.alert_active(recent, t.alerts, t.routes, start=start, end=end, kind="route")
    return lift(recent, active, min_observations=1)


def routes_asof(t: Tables) -> DataFrame:
    timed = alerts.active_alerts(t.alerts).select(
        "source_alert_id", F.coalesce("validity_start_utc", "created_at_utc").alias("start_utc"), "affected_routes_json"
    )
    listed = json_scalars(timed, "affected_routes_json", "route_ref").drop("affected_routes_json")
    return stops.resolve_route_names(listed, t.routes)


def followed_polls(t: Tables) -> DataFrame:
    """Polls with what precedes them, written once: gaps and cadence both read them."""
    return materialise(polls_with_gaps(t.polls), "collector_polls")


def success_gaps(t: Tables) -> DataFrame:
    return collector.success_gaps(followed_polls(t))


def missing_summary(t: Tables) -> DataFrame:
    polls = followed_polls(t)
    return collector.missing_summary(polls, collector.success_gaps(polls))


def long_spots(t: Tables) -> DataFrame:
    polls = collector.collector_polls(followed_polls(t), "view")
    return collector.missing_spots(collector.success_gaps(polls, 3.0, 2.0))


def stream_polls_once(t: Tables) -> DataFrame:
    """Collector polls that arrive late and twice, each once."""
    replay = Replay(t.polls, "attempted_at_utc").deliver()
    stream = streams.once(replay.stream(), "attempted_at_utc", replay.lateness)
    folder = new_folder(t.polls, "once")
    return streams.drain(stream, f"{folder}/rows", f"{folder}/checkpoint")[0]


def poll_times(t: Tables) -> DataFrame:
    """Polls by id, written once for all batches of a stream."""
    spark, name = t.polls.sparkSession, f"poll_times_{uuid.uuid4().hex}"
    return write_poll_times(t.polls, f"{application_folder(spark)}/{name}", name, streams.state_partitions(spark))


def stream_quality_rows(t: Tables) -> DataFrame:
    """Quality of observations as they arrive, stopped half-way and gone on with from the checkpoint."""
    polls = poll_times(t)
    replay, folder = Replay(t.observations, "created_at_utc"), new_folder(t.observations, "quality")
    for until in (replay.slices // 2, None):
        arrived = streams.once(replay.deliver(until).stream(), "created_at_utc", replay.lateness)
        rows, _ = streams.drain(streams.flagged(arrived, polls), f"{folder}/rows", f"{folder}/checkpoint")
    return quality_columns(rows)


def stream_line_hours(t: Tables) -> DataFrame:
    """Metrics by line and hour of the day over the hours that a stream has closed."""
    replay, folder = Replay(t.observations, "created_at_utc").deliver(), new_folder(t.observations, "hours")
    counted = streams.hour_histogram(streams.flagged(replay.stream(), poll_times(t)), replay.lateness)
    closed, _ = streams.drain(counted, f"{folder}/rows", f"{folder}/checkpoint")
    return dashboard.line_hour_metrics(streams.with_hour_calendar(closed), MIN)


def stream_cadence_alarms(t: Tables) -> DataFrame:
    """Alarms of sources without a success for ten minutes, raised and ended on a stream."""
    replay, folder = Replay(t.polls, "attempted_at_utc").deliver(), new_folder(t.polls, "alarms")
    alarms = streams.cadence_alarms(replay.stream(), CADENCE_SECONDS, replay.lateness)
    return streams.drain(alarms, f"{folder}/rows", f"{folder}/checkpoint")[0]


def overview(t: Tables) -> DataFrame:
    """From a written histogram: small, and read for the metrics and for the span."""
    return publish.overview(materialise(publish.daily_histogram(buckets_of(t)), "daily_histogram"), MIN)


def takeaways(t: Tables) -> DataFrame:
    written = materialise(rankings.delay_cube(buckets_of(t)), "delay_cube")
    metrics = rankings.line_metrics(written, MIN)
    return publish.takeaways(
        rankings.late_lines(metrics, LIMIT),
        rankings.early_lines(metrics, LIMIT),
        rankings.hourly_profile(written, MIN),
        rankings.rush_impact(written, MIN, LIMIT),
    )


def stop_search(t: Tables) -> DataFrame:
    written = written_buckets(t)
    metrics = materialise(publish.public_stop_metrics(written, MIN), "public_stop_metrics")
    canonical = publish.published_stops(publish.canonical_stops(t.stops, written), metrics)
    return publish.stop_points(canonical, metrics, day_type="weekday", mode="early", query="NATION")


def explorable(t: Tables) -> DataFrame:
    written = materialise(rankings.delay_cube(buckets_of(t)), "delay_cube")
    contexts = materialise(publish.public_contexts(written, MIN), "public_contexts")
    found = publish.explorable_lines(publish.public_lines(written, MIN), contexts)
    return found.select("line_ref", "line_name", "bucket_count", "p90_delay_min")


def line_rankings(t: Tables) -> DataFrame:
    metrics = materialise(rankings.line_metrics(buckets_of(t), MIN), "line_metrics")
    return rankings.line_rankings(metrics, TOP)


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    "source_profile": lambda t: source_summary(t.observations, t.polls, t.alerts),
    "quality_rows": lambda t: quality_columns(rows_of(t)),
    "quality_rows_strict": lambda t: quality_columns(rows_of(t, exclude_stop_call_disagreement=True)),
    "quality_rows_without_polls": lambda t: quality_columns(quality.quality_rows(t.observations)),
    "quality_summary": lambda t: quality.quality_summary(quality.quality_counts(rows_of(t))),
    "quality_rows_diagnostic": lambda t: quality_columns(rows_of(t, mode="diagnostic")),
    "quality_rows_raw": lambda t: quality_columns(rows_of(t, mode="raw")),
    "quality_rows_thresholds": lambda t: quality_columns(rows_of(t, **THRESHOLDS)),
    "quality_rows_colocated": quality_rows_colocated,
    "line_metrics_raw": line_metrics_raw,
    "quality_by_line": lambda t: rankings.numbered(
        quality.quality_by_line(quality.quality_counts(rows_of(t)), MIN, TOP)
    ),
    "quality_examples": lambda t: quality.quality_examples(rows_of(t), LIMIT),
    "buckets_trip_stop": bucket_modes("trip-stop"),
    "buckets_vehicle_trip": bucket_modes("vehicle-trip"),
    "buckets_line_hour": bucket_modes("line-hour"),
    "buckets_poll": bucket_modes("poll"),
    "buckets_windowed": windowed,
    "bucket_summary": lambda t: buckets.bucket_summary(buckets_of(t)),
    "line_robust": lambda t: rankings.numbered(rankings.robust_lines(buckets_of(t), MIN, TOP)),
    "line_late": lambda t: rankings.numbered(
        rankings.late_lines(rankings.line_metrics(buckets_of(t), MIN), TOP)
    ),
    "line_early": lambda t: rankings.numbered(
        rankings.early_lines(rankings.line_metrics(buckets_of(t), MIN), TOP)
    ),
    "line_rankings": line_rankings,
    "context_metrics": lambda t: rankings.context_metrics(buckets_of(t), MIN, LIMIT),
    "context_metrics_filtered": lambda t: rankings.context_metrics(
        buckets_of(t), MIN, LIMIT, line=LINE, direction="1", day_type="weekday"
    ),
    "hourly_profile": lambda t: rankings.hourly_profile(buckets_of(t), MIN),
    "hourly_profile_line": lambda t: rankings.hourly_profile(buckets_of(t), 1, line=LINE, by="robust", limit=10),
    "rush_impact": lambda t: rankings.numbered(rankings.rush_impact(buckets_of(t), MIN, TOP)),
    "rush_impact_overnight": lambda t: rankings.numbered(
        rankings.rush_impact(buckets_of(t), MIN, TOP, windows=("22:00-02:00",), include_weekends=True)
    ),
    "line_hour_metrics": lambda t: dashboard.line_hour_metrics(buckets_of(t), MIN),
    "line_hour_grid": lambda t: dashboard.line_hour_grid(dashboard.line_hour_metrics(buckets_of(t), MIN)),
    "prepared_observations": lambda t: dashboard.prepare_observations(t.observations, t.polls, t.stops),
    "stop_metrics": stop_metrics,
    "late_stops": lambda t: dashboard.late_stops(stop_metrics(t), 5),
    "early_stops": lambda t: dashboard.early_stops(stop_metrics(t), 5),
    "stop_heat": lambda t: dashboard.heat_weights(stop_metrics(t), "pct_over_3_min_early").select(
        "stop_id", "stop_name", "stop_lat", "stop_lon", "bucket_count", "heat_weight"
    ),
    "stop_heat_scaled": stop_heat_scaled,
    "stop_heat_shapes": stop_heat_shapes,
    "stop_markers": stop_markers,
    "selection_summary": lambda t: dashboard.selection_summary(buckets_of(t)),
    "filter_options": filter_options,
    "filtered_summary": filtered,
    "midpoint_summary": lambda t: change.midpoint_summary(buckets_of(t)),
    "stop_change_midpoint": midpoint_change,
    "stop_change_explicit": stop_change_explicit,
    "stop_change_recent": stop_change_recent,
    "city_part_change": city_part_change,
    "alert_targets": alert_targets,
    "alert_grouped": lambda t: alert_lift(t, False),
    "alert_by_line": lambda t: alert_lift(t, True),
    "alert_stops": lambda t: alert_lift(t, False, "stop"),
    "alert_recent_routes": alert_recent_routes,
    "collector_blackouts": lambda t: collector.collector_blackouts(polls_with_gaps(t.polls), LIMIT),
    "collector_gaps": lambda t: success_gaps(t),
    "collector_missing_spots": lambda t: collector.missing_spots(success_gaps(t), LIMIT),
    "collector_long_spots": long_spots,
    "collector_missing_summary": missing_summary,
    "stops_asof": lambda t: at_stop(t).select(
        "bucket_id", "stop_id", "gtfs_feed_date", "stop_name", "stop_lat", "stop_lon", "has_gtfs_stop_metadata"
    ),
    "stop_coverage": lambda t: stops.stop_coverage(at_stop(t)),
    "routes_asof": routes_asof,
    "canonical_stops": lambda t: publish.canonical_stops(t.stops, buckets_of(t)),
    "public_lines": lambda t: publish.public_lines(buckets_of(t), MIN),
    "public_contexts": lambda t: publish.public_contexts(buckets_of(t), MIN),
    "public_stops_grouping_sets": lambda t: publish.public_stop_metrics(buckets_of(t), MIN),
    "public_gaps": lambda t: publish.public_gaps(collector.missing_spots(success_gaps(t), LIMIT)),
    "overview": overview,
    "takeaways": takeaways,
    "default_line": lambda t: publish.default_line(publish.public_contexts(buckets_of(t), MIN), "1", "weekday"),
    "explorable_lines": explorable,
    "line_contexts": lambda t: publish.line_contexts(
        publish.public_contexts(buckets_of(t), 1), LINE, "1", "weekday", 18, 6
    ),
    "stop_search": stop_search,
    "results_read_back": results_read_back,
    "csv_round_trip": csv_round_trip,
    "json_round_trip": json_round_trip,
    "line_documents": line_documents,
    "publication_checks": publication_checks,
    "feeds_read_back": feeds_read_back,
    "stops_asof_files": stops_asof_files,
    "stream_polls_once": stream_polls_once,
    "stream_quality_rows": stream_quality_rows,
    "stream_line_hours": stream_line_hours,
    "stream_cadence_alarms": stream_cadence_alarms,
}


def as_query(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plain(build(tables(spark, sf_dir)))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: as_query(build) for name, build in QUERIES.items()}
