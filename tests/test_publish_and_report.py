from __future__ import annotations

import glob
import json
import os
import subprocess
import sys
from datetime import date
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from punctual import session
from punctual.operators import buckets, dashboard, publish, quality
from punctual.plans import report
from punctual.plans.tables import Tables
from punctual.schemas import OBSERVATION_SCHEMA, STOP_SCHEMA
from punctual.sources import readers, sinks
from tests.conftest import dicts, utc
from tests.fixtures import observation, observations, report_tables

ROOT = Path(__file__).resolve().parent.parent
BUCKET = (
    "next_stop_point_ref string, next_stop_point_name string, line_ref string, direction_ref string,"
    " published_line_name string, day_type string, local_hour int, delay_seconds double, raw_poll_count long,"
    " representative_time_utc timestamp, local_date date"
)


def bucket(stop="10", name="A", line="3", hour=8, kind="weekday", delay=60.0, direction="1", day=23):
    return (stop, name, line, direction, line, kind, hour, delay, 1, utc(f"2026-04-{day}T08:00:00"), date(2026, 4, day))


def table(spark, *rows):
    return spark.createDataFrame(list(rows), BUCKET)


def test_canonical_stops(spark):
    stops = spark.createDataFrame(
        [(date(2026, 4, 23), "10", "Old name", 60.45, 22.27), (date(2026, 5, 21), "10", "Current name", 60.46, 22.28)],
        STOP_SCHEMA,
    )
    rows = table(spark, bucket(), bucket(line="4"), bucket("20", "First"), bucket("20", "Last", day=24), bucket("30", None))
    found = {r.stop_id: (r.stop_name, r.line_count) for r in publish.canonical_stops(stops, rows).collect()}
    assert found == {"10": ("Current name", 2), "20": ("Last", 1), "30": ("30", 1)}
    assert publish.canonical_stops(None, rows).first().stop_name == "A"


def test_stop_metrics_cover_all_groupings_with_a_minimum(spark):
    rows = table(spark, bucket(), bucket(), bucket(kind="weekend"), bucket("20", line="4"))
    found = {(r.stop_id, r.line_ref, r.day_type): r.bucket_count for r in publish.public_stop_metrics(rows, 2).collect()}
    assert found == {("10", "all", "all"): 3, ("10", "all", "weekday"): 2, ("10", "3", "all"): 3, ("10", "3", "weekday"): 2}
    canonical = publish.canonical_stops(None, rows)
    published = publish.published_stops(canonical, publish.public_stop_metrics(rows, 2))
    assert [r.stop_id for r in published.collect()] == ["10"]


def test_selections(spark):
    rows = table(spark, bucket(hour=7), bucket(hour=8), bucket(line="10", hour=7), bucket(line="10", hour=8),
                 bucket(line="10", hour=8), bucket(line="2", hour=9, direction="2"))
    lines, contexts = publish.public_lines(rows, 1), publish.public_contexts(rows, 1)
    assert publish.default_line(contexts, "1", "weekday").first().line_ref == "10"
    assert publish.default_line(contexts, "2", "weekend").count() == 0
    assert [r.line_ref for r in publish.explorable_lines(lines, contexts).collect()] == ["2", "3", "10"]
    assert publish.hour_range(9, 7) == (7, 9) and publish.hour_range(None, None) == (0, 23)
    assert [r.local_hour for r in publish.line_contexts(contexts, "10", "1", "weekday", 8, 7).collect()] == [7, 8]


def test_stop_search_folds_case(spark):
    stops = spark.createDataFrame([("10", "Kauppatori"), ("20", "SATAMA")], "stop_id string, stop_name string")
    metrics = publish.public_stop_metrics(table(spark, bucket(delay=600.0), bucket("20", delay=-300.0)), 1)
    assert [r.stop_id for r in publish.stop_points(stops, metrics, query="Satama").collect()] == ["20"]
    assert [r.stop_id for r in publish.stop_points(stops, metrics).collect()] == ["10", "20"]
    assert publish.stop_points(stops, metrics, mode="early").first().display_value == 5.0
    assert publish.stop_points(stops, metrics, query="1").first().stop_id == "10"


def test_contract(spark):
    nested = spark.sql("select 1 as schema_version, array(named_struct('vehicle_id', 'x')) rows")
    with pytest.raises(ValueError, match="forbidden public keys: vehicle_id"):
        publish.validate_public("bad", nested)
    with pytest.raises(ValueError, match="missing required columns: line_ref"):
        publish.validate_public("bad", spark.sql("select 1 as schema_version, 1 as n"), ["line_ref"])
    with pytest.raises(ValueError, match="non-finite"):
        publish.validate_public("bad", spark.sql("select 1 as schema_version, double('NaN') as n"))
    with pytest.raises(ValueError, match="local paths"):
        publish.validate_public("bad", spark.sql("select 1 as schema_version, '/srv/data/x' as source"), local_paths=["/srv/data"])
    publish.validate_public("good", spark.sql("select 1 as schema_version, 'x' as a, 1.0D as b, array(1.0D) as c"))
    with pytest.raises(ValueError, match="no schema version"):
        publish.validate_public("bad", spark.sql("select 1 as n"))
    with pytest.raises(ValueError, match="unsupported schema version"):
        publish.validate_public("bad", spark.sql("select explode(array(1, 2)) as schema_version"))
    with pytest.raises(ValueError, match="unsupported schema version"):
        publish.validate_public("bad", spark.sql("select int(null) as schema_version"))


def test_every_section_has_required_fields():
    assert len(publish.REQUIRED) == 13 and all(publish.REQUIRED.values())


def test_scratch_owns_its_tables(spark):
    with session.scratch(spark) as folder:
        kept = session.materialise(spark.range(3), "inside")
        assert kept.count() == 3 and folder in kept.inputFiles()[0]
    assert not os.path.exists(folder.removeprefix("file:"))
    outside = session.materialise(spark.range(2), "outside")
    assert outside.count() == 2


def test_limit_must_be_positive():
    with pytest.raises(ValueError, match="limit"):
        report.ReportSettings(limit=0)


def test_buckets_are_pruned_by_day(spark, tmp_path):
    """Both time columns reach the scan, and a range of days opens its own folders only."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    rows = report_tables(spark).observations
    rows.write.parquet(str(tmp_path / "observations"))
    stored = spark.read.parquet(str(tmp_path / "observations"))
    chosen = quality.select_rows(stored, start=utc("2026-04-30T00:00:00"), end=utc("2026-05-01T00:00:00"))
    assert sorted(r.id for r in chosen.collect()) == [3, 4, 5]
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    assert "next_aimed_arrival_time_utc" in pushed and "recorded_at_utc" in pushed
    built = buckets.delay_buckets(quality.quality_rows(stored))
    written = sinks.write_table(built, str(tmp_path), "delay_buckets", by_day="local_date")
    assert written.columns == built.columns
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, built.collect()))
    one = dashboard.filter_buckets(written, start_date=date(2026, 4, 30))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "local_date" in plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]
    assert one.count() == 2


def test_json_is_sorted_rounded_and_utf8(spark, tmp_path):
    df = spark.createDataFrame([("Ålesund", 1.23456, None, date(2026, 4, 23))], "name string, b double, a int, day date")
    sinks.write_json(df, str(tmp_path / "out"), name="out")
    text = "".join(Path(p).read_text(encoding="utf-8") for p in glob.glob(str(tmp_path / "out" / "*.json")))
    assert text == '{"a":null,"b":1.23,"day":"2026-04-23","name":"Ålesund","schema_version":1}\n'


def test_checks_run_while_writing(spark, tmp_path):
    """One job writes and counts; rows that break the contract leave nothing, not even beside the target."""
    good = spark.range(40).select((F.col("id") * 1.5).alias("n"), F.lit(1).alias("schema_version"))
    faults = {
        "unsupported schema version": good.withColumn("schema_version", F.when(F.col("n") > 50, 2).otherwise(1)),
        "non-finite": good.withColumn("n", F.when(F.col("n") > 50, float("nan")).otherwise(F.col("n"))),
        "local paths": good.withColumn("rows", F.array(F.struct(F.lit("/srv/data/x").alias("file")))),
    }
    for message, bad in faults.items():
        with pytest.raises(ValueError, match=message):
            sinks.write_checked(bad, str(tmp_path / "out"), "bad", ["/srv/data"])
    assert os.listdir(tmp_path) == []
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("publish", "one section")
    counts = sinks.write_json(good, str(tmp_path / "out"), name="out")
    jobs = len(tracker.getJobIdsForGroup("publish"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs == 1 and counts["row_count"] == 40 and os.listdir(tmp_path) == ["out"]
    with pytest.raises(ValueError, match="non-finite"):
        sinks.write_json(faults["non-finite"], str(tmp_path / "out"), name="out")
    assert spark.read.json(str(tmp_path / "out")).count() == 40
    assert sinks.write_json(good.filter("false"), str(tmp_path / "empty"), name="empty")["row_count"] == 0


def test_csv_and_labelled_views(spark, tmp_path):
    late, early = spark.sql("select 1 as a, 2.345D as b"), spark.sql("select 1 as a, 'x' as c")
    both = sinks.labelled_union({"late": late, "early": early})
    assert both.columns == ["view", "a", "b", "c"]
    sinks.write_csv(both, str(tmp_path / "views"), digits=1)
    rows = spark.read.csv(str(tmp_path / "views"), header=True).collect()
    assert sorted((r.view, r.b) for r in rows) == [("early", None), ("late", "2.3")]
    with pytest.raises(ValueError):
        sinks.labelled_union({})


def test_full_report_and_snapshot(spark, tmp_path):
    tables = report_tables(spark)
    settings = report.ReportSettings(min_observations=1, limit=5)
    root = str(tmp_path / "report")
    built = report.build_report(tables, root, settings)
    assert set(report.RESULT_TABLES) <= set(built)
    summary = {r["quality_check"]: r["row_count"] for r in dicts(built["quality_summary"])}
    assert summary["is_implausible_delay"] == 1
    found = {(r.line_ref, r.next_stop_point_ref, r.delay_seconds): r.raw_poll_count for r in built["delay_buckets"].collect()}
    assert found["3", "10", 120.0] == 2 and max(k[2] for k in found) <= 7200
    change = built["stop_midpoint_change"].first()
    assert (change.stop_id, change.p90_delay_change_min) == ("10", 8.0)
    assert built["collector_blackouts"].count() == built["collector_missing_spots"].count() == 1
    alert = built["service_alert_by_line"].first()
    assert alert is None or alert.line_ref == "3"
    assert readers.read_result(spark, root, "rush_impact").columns == built["rush_impact"].columns
    assert readers.read_result(spark, root, "absent").columns == []
    header = spark.read.csv(f"{root}/csv/hourly_delay_profile", header=True).columns
    assert header == built["hourly_delay_profile"].columns

    sections = report.build_public_snapshot(built, None, str(tmp_path / "public"), settings, min_buckets=1)
    assert len(sections) == 13
    meta = spark.read.json(str(tmp_path / "public" / "overview" / "meta")).first()
    assert meta.schema_version == 1 and meta.analysis_start_utc == "2026-04-23T08:00+00:00"
    gap = spark.read.json(str(tmp_path / "public" / "context" / "collector_gaps")).first()
    assert gap.gap_start_utc == "2026-04-23T08:01+00:00"
    for path in glob.glob(str(tmp_path / "public" / "*" / "*" / "*.json")):
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            assert not publish.FORBIDDEN_KEYS & set(json.loads(line))
    with pytest.raises(ValueError):
        report.build_public_snapshot(built, None, str(tmp_path / "x"), min_buckets=0)


def test_report_without_optional_tables(spark, tmp_path):
    built = report.build_report(
        Tables(report_tables(spark).observations), str(tmp_path), report.ReportSettings(min_observations=1), csv=False
    )
    for name in ("collector_blackouts", "collector_missing_spots", "service_alert_grouped", "service_alert_by_line"):
        assert built[name].count() == 0 and built[name].columns
    assert built["source_profile"].first().collector_poll_count == 0


def test_settings_are_checked():
    for bad in ({"quality_mode": "x"}, {"bucket": "x"}, {"min_observations": 0}, {"rush_windows": ("07:00-07:00",)}):
        with pytest.raises(ValueError):
            report.ReportSettings(**bad)


def test_reading_text_tables(spark, tmp_path):
    rows = observations(spark, [observation(1, "2026-04-23T08:00:00", 60)])
    iso = rows.select(*[
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c) if t == "timestamp" else F.col(c) for c, t in rows.dtypes
    ]).withColumn("valid_until_utc", F.lit("not a time")).withColumn("delay_seconds", F.lit("60"))
    iso.write.parquet(str(tmp_path / "vehicle_observations"))
    tables = readers.read_source_tables(spark, str(tmp_path))
    assert tables.polls is None and tables.alerts is None
    assert tables.observations.schema["recorded_at_utc"].dataType == OBSERVATION_SCHEMA["recorded_at_utc"].dataType
    row = tables.observations.first()
    assert (row.valid_until_utc, row.delay_seconds) == (None, 60.0)
    assert readers.limited(tables.observations, 0).count() == 0
    counted = readers.read_sql(spark, "select count(*) n from {obs} where line_ref = :line", {"line": "3"}, obs=tables.observations)
    assert counted.first().n == 1
    with pytest.raises(FileNotFoundError):
        readers.read_source_tables(spark, str(tmp_path / "nowhere"))


def test_dashboard_rows(spark):
    """Most columns absent: the stop-10 polls share one bucket."""
    data = [("2026-04-23T08:05:22Z", "3", "1", "3", 60, "10"), ("2026-04-23T08:10:22Z", "3", "1", "3", -120, "10"),
            ("2026-04-23T08:15:22Z", "3", "1", "3", 0, "10"), ("2026-04-23T08:20:22Z", "4", "2", "4", 240, "20")]
    rows = spark.createDataFrame(
        data, "recorded_at_utc string, line_ref string, direction_ref string, published_line_name string,"
        " delay_seconds long, next_stop_point_ref string"
    ).withColumn("is_gtfs_matchable", F.lit(1))
    stops = spark.createDataFrame([("10", "Keskusta", 60.45, 22.27), ("20", "Satama", 60.43, 22.22)],
                                  "stop_id string, gtfs_stop_name string, stop_lat double, stop_lon double")
    prepared = dashboard.prepare_observations(rows, None, stops)
    first = prepared.orderBy("stop_id").first()
    assert (first.raw_poll_count, first.delay_seconds, first.local_minute_of_day) == (3, 0.0, 665)
    assert (first.stop_name, first.stop_lat) == ("Keskusta", 60.45)
    metrics = dashboard.stop_metrics(prepared)
    assert [r.stop_id for r in dashboard.late_stops(metrics).collect()] == ["20", "10"]
    unlocated = dashboard.stop_metrics(dashboard.with_stop_metadata(prepared, None))
    assert sorted(r.line_count for r in unlocated.collect()) == [1, 1]
    options = dashboard.filter_options(prepared).first()
    assert (options.line_options, options.direction_options) == (["3", "4"], ["1", "2"])


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="driver tables are absent")
@pytest.mark.parametrize("name", ["line_late", "stops_asof", "collector_missing_summary", "alert_recent_routes"])
def test_registered_queries_match_duckdb(spark, name):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry
    from tools.check_oracles import canonical

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, folder)
    expected = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(expected.fetchall(), columns)


def test_every_query_has_an_oracle_and_imports_need_no_session():
    script = "import __spark_entry__ as e; from punctual.plans.catalogue import all_queries; assert set(all_queries()) <= set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", script], cwd=ROOT, check=True)
