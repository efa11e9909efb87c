"""The full report and the public snapshot, from source tables to written results."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from punctual.functions.times import minute_text, rush_windows
from punctual.operators import alerts, buckets, change, collector, publish, quality, rankings
from punctual.plans.tables import Tables
from punctual.schemas import ALERT_SCHEMA, BUCKET_MODES, DEFAULT_RUSH_WINDOWS, DEFAULT_TIMEZONE, POLL_SCHEMA, QUALITY_MODES
from punctual.session import materialise, scratch
from punctual.sources.readers import source_summary
from punctual.sources.sinks import write_csv, write_json, write_table, write_tables

# The published results, in their published order.
RESULT_TABLES = (
    "quality_summary",
    "quality_by_line",
    "line_late_rankings",
    "line_early_rankings",
    "context_delay_metrics",
    "hourly_delay_profile",
    "rush_impact",
    "stop_midpoint_change",
    "service_alert_grouped",
    "service_alert_by_line",
    "collector_blackouts",
    "collector_missing_summary",
    "collector_missing_spots",
)


@dataclass(frozen=True)
class ReportSettings:
    quality_mode: str = "conservative"
    exclude_stop_call_disagreement: bool = False
    bucket: str = "trip-stop"
    timezone: str = DEFAULT_TIMEZONE
    rush_windows: tuple[str, ...] = DEFAULT_RUSH_WINDOWS
    include_weekends: bool = False
    min_observations: int = 30
    limit: int = 20

    def __post_init__(self) -> None:
        if self.quality_mode not in QUALITY_MODES:
            raise ValueError(f"quality mode must be one of {', '.join(QUALITY_MODES)}")
        if self.bucket not in BUCKET_MODES:
            raise ValueError(f"bucket must be one of {', '.join(BUCKET_MODES)}")
        if self.min_observations < 1:
            raise ValueError("min_observations must be at least 1")
        if self.limit < 1:
            raise ValueError("limit must be at least 1")
        rush_windows(self.rush_windows)


def build_base(tables: Tables, root: str, settings: ReportSettings) -> dict[str, DataFrame]:
    """Write what the results share: quality counts, buckets and the delay cube.

    The observations are read twice, once narrow for the counts; flagged rows
    are never stored. Only these tables are read afterwards.
    """
    rows = quality.quality_rows(
        tables.observations,
        tables.polls,
        mode=settings.quality_mode,
        exclude_stop_call_disagreement=settings.exclude_stop_call_disagreement,
    )
    base = {"quality_counts": write_table(quality.quality_counts(rows), root, "quality_counts")}
    base["delay_buckets"] = write_table(
        buckets.delay_buckets(rows, settings.bucket, settings.timezone), root, "delay_buckets", by_day="local_date"
    )
    cube = rankings.delay_cube(base["delay_buckets"], settings.rush_windows, settings.include_weekends)
    base["delay_cube"] = write_table(cube, root, "delay_cube")
    return base


def report_results(tables: Tables, base: dict[str, DataFrame], settings: ReportSettings, root: str) -> dict[str, DataFrame]:
    """The result tables by name; absent polls or alerts leave theirs empty."""
    spark = tables.observations.sparkSession
    polls = tables.polls if tables.polls is not None else spark.createDataFrame([], POLL_SCHEMA)
    alert_table = tables.alerts if tables.alerts is not None else spark.createDataFrame([], ALERT_SCHEMA)
    least, limit = settings.min_observations, settings.limit
    cube, written = base["delay_cube"], base["delay_buckets"]
    active = alerts.alert_active(written, alert_table, tables.routes, timezone=settings.timezone)
    shared = write_tables(
        {
            "delay_metrics": rankings.cube_metrics(cube, least),
            "collector_success_gaps": collector.success_gaps(polls),
            "alert_active_histogram": active,
        },
        root,
    )
    metrics, gaps, active = shared.values()
    parts = rankings.cube_parts(metrics)
    controls = write_table(alerts.control_histogram(written, active), root, "alert_control_histogram")
    return {
        "quality_summary": quality.quality_summary(base["quality_counts"]),
        "quality_by_line": quality.quality_by_line(base["quality_counts"], least, limit),
        "line_late_rankings": rankings.late_lines(parts["line"], limit),
        "line_early_rankings": rankings.early_lines(parts["line"], limit),
        "context_delay_metrics": rankings.ranked_contexts(parts["context"], limit),
        "hourly_delay_profile": rankings.ordered_hours(parts["hour"]),
        "rush_impact": rankings.compared_rush(parts["rush"], limit),
        "midpoint_summary": change.midpoint_summary(written),
        "stop_midpoint_change": change.midpoint_change(written, least, limit),
        "delay_cache_summary": buckets.bucket_summary(written),
        "source_profile": source_summary(tables.observations, tables.polls, tables.alerts),
        "collector_blackouts": collector.collector_blackouts(polls, limit),
        "collector_missing_summary": collector.missing_summary(polls, gaps),
        "collector_missing_spots": collector.missing_spots(gaps, limit),
        "service_alert_grouped": alerts.alert_lift(active, controls, min_observations=least, limit=limit),
        "service_alert_by_line": alerts.alert_lift(active, controls, by_line=True, min_observations=least, limit=limit),
    }


def build_report(
    tables: Tables, root: str, settings: ReportSettings | None = None, *, csv: bool = True
) -> dict[str, DataFrame]:
    """Build every result once, as Parquet under `root` and as CSV under `root/csv`."""
    settings = settings or ReportSettings()
    base = build_base(tables, root, settings)
    results = write_tables(report_results(tables, base, settings, root), root)
    if csv:
        for name in RESULT_TABLES:
            write_csv(results[name], f"{root}/csv/{name}")
    return {**base, **results}


def build_public_snapshot(
    report: dict[str, DataFrame],
    stops: DataFrame | None,
    root: str,
    settings: ReportSettings | None = None,
    *,
    min_buckets: int = publish.MIN_BUCKETS,
    local_paths: tuple[str, ...] = (),
) -> list[str]:
    """Write the published payloads from a finished report, one folder per section.

    Sections are JSON lines, so none is gathered in one task however long it is.
    """
    if min_buckets < 1:
        raise ValueError("min_buckets must be at least 1")
    with scratch(report["delay_buckets"].sparkSession):
        sections = snapshot_sections(report, stops, settings or ReportSettings(), min_buckets)
        write_sections(sections, root, local_paths)
    return list(sections)


def write_sections(sections: dict[str, DataFrame], root: str, local_paths: tuple[str, ...], at_once: int = 4) -> None:
    """Check and write the sections, a few at a time: most are small."""

    def write(name: str) -> None:
        required = publish.REQUIRED[name.replace("stops/metrics", "stop_metrics").split("/")[-1]]
        write_json(sections[name], f"{root}/{name}", name=name, required=required, local_paths=local_paths)

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        # Each job sees the scratch folder of this one.
        for job in [pool.submit(copy_context().run, write, name) for name in sections]:
            job.result()


def snapshot_sections(
    report: dict[str, DataFrame], stops: DataFrame | None, settings: ReportSettings, min_buckets: int
) -> dict[str, DataFrame]:
    """The published tables by section."""
    cube, written = report["delay_cube"], report["delay_buckets"]
    metrics = materialise(publish.public_stop_metrics(written, min_buckets), "public_stop_metrics")
    daily = materialise(publish.daily_histogram(written), "daily_histogram")
    canonical = publish.canonical_stops(stops, written)
    excluded = report["quality_summary"].filter("quality_check = 'conservative_excluded_default'")
    profile = report["source_profile"]
    meta = profile.select(
        F.lit(publish.SCHEMA_VERSION).alias("schema_version"),
        minute_text(F.current_timestamp()).alias("generated_at_utc"),
        minute_text("analysis_start_utc").alias("analysis_start_utc"),
        minute_text("analysis_end_utc").alias("analysis_end_utc"),
        F.lit(settings.timezone).alias("timezone"),
        F.lit(settings.bucket).alias("bucket_mode"),
        F.lit(settings.quality_mode).alias("quality_mode"),
        F.lit(min_buckets).alias("minimum_bucket_count"),
        F.coalesce(excluded.select("pct_rows").scalar(), F.lit(0.0)).alias("conservative_excluded_pct"),
    )
    rush = report["rush_impact"]
    hours = publish.public_hours(cube, min_buckets)
    return {
        "overview/meta": meta,
        "overview/summary": publish.overview(daily, min_buckets),
        "overview/hourly_profile": hours,
        "overview/takeaways": publish.takeaways(
            report["line_late_rankings"], report["line_early_rankings"], hours, rush
        ),
        "lines/lines": publish.public_lines(cube, min_buckets),
        "lines/contexts": publish.public_contexts(cube, min_buckets),
        "stops/stops": publish.published_stops(canonical, metrics),
        "stops/metrics": metrics,
        "context/rush_impact": rush,
        "context/alerts": report["service_alert_grouped"],
        "context/collector_gaps": publish.public_gaps(report["collector_missing_spots"]),
        "context/quality": report["quality_summary"],
        "context/stop_changes": report["stop_midpoint_change"],
    }
