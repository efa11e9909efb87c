"""Headline timings: the full report (base build and every result) and single queries.

Prints one JSON line. The source tables are derived from the driver's events and
written first, outside the timed part, as the analysis starts from stored polls.
BENCH_FACTOR copies them with new ids, vehicles, trips and poll sources, so that
BENCH_FACTOR=105 at sf0.1 gives a report over 10.5 million observations; the
single queries, which read the driver's tables, then are left out.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, functions as F  # noqa: E402

from punctual.plans import report  # noqa: E402
from punctual.plans.adapter import polls_with_gaps, tables  # noqa: E402
from punctual.plans.catalogue import all_queries  # noqa: E402
from punctual.plans.tables import Tables  # noqa: E402
from punctual.session import build_session  # noqa: E402
from punctual.sources.sinks import write_table, write_tables  # noqa: E402

FACTOR = int(os.environ.get("BENCH_FACTOR", "1"))
#: Apart from any id of the driver's tables.
COPY_STEP = 1_000_000_000
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "quality_summary",
    "buckets_trip_stop",
    "line_late",
    "context_metrics",
    "rush_impact",
    "stop_metrics",
    "public_stops_grouping_sets",
    "stop_change_midpoint",
    "alert_grouped",
    "collector_missing_spots",
)


def copied(df: DataFrame, ids: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """FACTOR copies of a table, told apart by their ids and names."""
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(FACTOR - 1))))
    moved = {c: F.col(c) + F.col("copy").cast("long") * COPY_STEP for c in ids}
    named = {c: F.concat_ws("-", c, F.col("copy").cast("string")) for c in names}
    return copies.withColumns(moved | named).drop("copy")


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench-")
    spark.sparkContext.setCheckpointDir(f"{folder}/shared")
    timings: dict[str, float] = {}

    def timed(name, action):
        started = time.perf_counter()
        outcome = action()
        timings[name] = round(time.perf_counter() - started, 3)
        return outcome

    driver = tables(spark, SF_DIR)
    source = f"{folder}/source"
    stored = Tables(
        observations=write_table(
            copied(driver.observations, ("id", "poll_id"), ("vehicle_id", "trip_match_key")), source, "vehicle_observations"
        ),
        polls=write_table(copied(polls_with_gaps(driver.polls), ("id",), ("source",)), source, "collector_polls"),
        alerts=write_table(driver.alerts, source, "service_alerts"),
        stops=driver.stops,
        routes=driver.routes,
        city_parts=driver.city_parts,
    )
    settings = report.ReportSettings(min_observations=5)
    base = timed("report_base", lambda: report.build_base(stored, f"{folder}/report", settings))

    report_root = f"{folder}/report"
    timed(
        "report_results",
        lambda: write_tables(report.report_results(stored, base, settings, report_root), report_root),
    )
    queries = all_queries()
    for name in HEADLINE if FACTOR == 1 else ():
        timed(name, lambda: queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "punctuality_total_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "observations": stored.observations.count(),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
