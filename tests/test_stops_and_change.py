from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from punctual.operators import buckets, change, quality, stops
from punctual.plans.catalogue import plain
from punctual.schemas import ROUTE_SCHEMA, STOP_SCHEMA
from punctual.session import materialise
from punctual.sources import gtfs
from tests.conftest import utc
from tests.fixtures import observation, observations, report_tables


def feed_stops(spark):
    return spark.createDataFrame(
        [(date(2026, 4, 23), "10", "First feed", 60.0, 22.0), (date(2026, 4, 30), "10", "Second feed", 60.1, 22.1)],
        STOP_SCHEMA,
    )


def test_feed_in_force_per_day(spark):
    days = spark.createDataFrame(
        [(date(2026, 4, 22), "10", "Reported"), (date(2026, 4, 23), "10", "Reported"), (date(2026, 4, 30), "10", "Reported"),
         (date(2031, 1, 1), "10", "Reported"), (date(2026, 4, 30), None, None)],
        "local_date date, next_stop_point_ref string, next_stop_point_name string",
    )
    found = stops.with_stop_metadata(days, feed_stops(spark))
    rows = {(r.local_date, r.stop_id): (r.gtfs_feed_date, r.stop_name) for r in found.collect()}
    assert rows[date(2026, 4, 22), "10"] == (None, "Reported")
    assert rows[date(2026, 4, 23), "10"] == (date(2026, 4, 23), "First feed")
    assert rows[date(2026, 4, 30), "10"] == rows[date(2031, 1, 1), "10"] == (date(2026, 4, 30), "Second feed")
    assert rows[date(2026, 4, 30), None] == (date(2026, 4, 30), None)
    coverage = stops.stop_coverage(found).first()
    assert (coverage.bucket_count, coverage.unmatched_gtfs_count) == (5, 2)
    feeds = [date(2026, 4, 23), date(2026, 4, 30)]
    assert [stops.feed_for_day(feeds, date(2026, 4, d)) for d in (22, 29, 30)] == [None, feeds[0], feeds[1]]


def test_feeds_have_no_last_day(spark):
    stops_of = spark.createDataFrame(
        [(date(2024, 1, 1), "10", "Old", 1.0, 2.0), (date(2101, 6, 1), "10", "New", 1.0, 2.0)], STOP_SCHEMA
    )
    days = spark.createDataFrame(
        [(d, "10", "Reported") for d in (date(2023, 12, 31), date(2024, 1, 1), date(2100, 5, 1), date(2101, 5, 31),
                                         date(2101, 6, 1), date(2105, 1, 1))] + [(None, "10", "Reported")],
        "local_date date, next_stop_point_ref string, next_stop_point_name string",
    )
    found = {r.local_date: r.stop_name for r in stops.with_stop_metadata(days, stops_of).collect()}
    assert found == {
        date(2023, 12, 31): "Reported", date(2024, 1, 1): "Old", date(2100, 5, 1): "Old", date(2101, 5, 31): "Old",
        date(2101, 6, 1): "New", date(2105, 1, 1): "New", None: "Reported",
    }
    late_only = stops_of.filter(F.col("gtfs_feed_date") > date(2100, 1, 1))
    found = {r.local_date: r.stop_name for r in stops.with_stop_metadata(days, late_only).collect()}
    assert found[date(2100, 5, 1)] == "Reported" and found[date(2105, 1, 1)] == "New"
    assert {r.stop_name for r in stops.with_stop_metadata(days, stops_of.limit(0)).collect()} == {"Reported"}


def test_forced_feed_and_no_feed(spark):
    days = spark.createDataFrame([(date(2020, 1, 1), "10", "Reported")],
                                 "local_date date, next_stop_point_ref string, next_stop_point_name string")
    forced = stops.with_stop_metadata(days, feed_stops(spark).limit(1).drop("gtfs_feed_date")).first()
    assert (forced.stop_name, forced.gtfs_feed_date) == ("First feed", None)
    assert stops.with_stop_metadata(days, None).first().stop_name == "Reported"


def test_routes_by_feed_date(spark):
    refs = spark.createDataFrame(
        [("route-a", utc(f"2026-04-{d}T09:00:00")) for d in (22, 23, 30)], "route_ref string, start_utc timestamp"
    )
    routes = spark.createDataFrame([(date(2026, 4, 23), "route-a", "3"), (date(2026, 4, 30), "route-a", "4")], ROUTE_SCHEMA)
    named = stops.resolve_route_names(refs, routes).orderBy("start_utc")
    assert [r.target_ref for r in named.collect()] == ["route-a", "3", "4"]
    # 22:30 UTC is already the next day in Helsinki.
    late = refs.limit(1).withColumn("start_utc", F.lit(utc("2026-04-22T22:30:00")))
    assert stops.resolve_route_names(late, routes).first().target_ref == "3"


def test_feeds_of_one_header_are_one_scan(spark, tmp_path):
    scans = []
    for count in (2, 30):
        for n in range(count):
            folder = tmp_path / str(count) / f"gtfs_20{10 + n}-01-01"
            folder.mkdir(parents=True)
            (folder / "stops.txt").write_text(f"stop_id,stop_name,stop_lat,stop_lon\n1,Feed {n},1,2\n", encoding="utf-8")
        found = gtfs.read_stops(spark, gtfs_root=f"file:{tmp_path}/{count}")
        assert {r.gtfs_stop_name for r in found.collect()} == {f"Feed {n}" for n in range(count)}
        scans.append(found._jdf.queryExecution().analyzed().toString().count("Relation ["))
    assert scans == [1, 1]


def test_reading_feeds(spark, tmp_path):
    for day, header, row in (
        ("2026-04-23", "stop_id,stop_name,stop_lat,stop_lon", '10,"Old, name",60.45,22.27\n10,Again,1,1\n20,Bad,x,'),
        ("2026-05-21", "stop_lat,stop_id,zone,stop_lon,stop_name", "60.46,10,A,22.28,Current"),
    ):
        folder = tmp_path / f"gtfs_{day}"
        folder.mkdir()
        (folder / "stops.txt").write_text(f"{header}\n{row}\n", encoding="utf-8")
    (tmp_path / "gtfs_2026-05-21" / "routes.txt").write_text("route_id,route_short_name\nr1,3\n", encoding="utf-8")
    (tmp_path / "gtfs_latest").mkdir()
    (tmp_path / "gtfs_latest" / "stops.txt").write_text("stop_id\n1\n", encoding="utf-8")
    root = f"file:{tmp_path}"
    assert [d for d, _ in gtfs.feed_list(spark, root, "stops.txt")] == [date(2026, 4, 23), date(2026, 5, 21)]
    assert [d for d, _ in gtfs.feed_list(spark, root, "routes.txt")] == [date(2026, 5, 21)]
    assert gtfs.latest_feed(spark, root).endswith("gtfs_2026-05-21")
    rows = sorted(tuple(r) for r in gtfs.read_stops(spark, gtfs_root=root).select(
        "gtfs_feed_date", "stop_id", "gtfs_stop_name", "stop_lat").collect())
    assert rows == [(date(2026, 4, 23), "10", "Old, name", 60.45), (date(2026, 4, 23), "20", "Bad", None),
                    (date(2026, 5, 21), "10", "Current", 60.46)]
    assert gtfs.read_stops(spark, gtfs_dir=f"{root}/gtfs_2026-05-21").first().gtfs_stop_name == "Current"
    assert gtfs.read_routes(spark, gtfs_root=root).first().route_short_name == "3"
    with pytest.raises(ValueError, match="stop_lat, stop_lon, stop_name"):
        gtfs.read_stops(spark, gtfs_dir=f"{root}/gtfs_latest")
    assert gtfs.read_stops(spark, gtfs_root=f"{root}/nowhere").count() == 0
    assert gtfs.latest_feed(spark, f"{root}/nowhere") is None
    (tmp_path / "parts.csv").write_text("stop_id,city_part\n10,Centre\n", encoding="utf-8")
    assert gtfs.read_city_parts(spark, f"{root}/parts.csv").first().city_part == "Centre"


def test_matched_contexts(spark):
    rows = spark.createDataFrame(
        [("baseline", "10", "3", "1", 0, 8, 60.0), ("comparison", "10", "3", "1", 0, 8, 120.0),
         ("comparison", "10", "3", "1", 1, 8, 180.0)],
        "period string, stop_id string, line_ref string, direction_ref string, local_weekday int, local_hour int,"
        " delay_seconds double",
    )
    kept = change.matched_histogram(rows, ["stop_id"], [])
    assert sorted(r.delay_seconds for r in kept.collect()) == [60.0, 120.0]


def written(spark, tables):
    return materialise(buckets.delay_buckets(quality.quality_rows(tables.observations, tables.polls)), "buckets")


def test_midpoint_change_of_the_report_fixture(spark):
    table = written(spark, report_tables(spark))
    row = change.midpoint_change(table).collect()
    assert [(r.stop_id, r.stop_name, r.baseline_p90_delay_min, r.comparison_p90_delay_min, r.p90_delay_change_min)
            for r in row] == [("10", "Market", 2.0, 10.0, 8.0)]
    summary = change.midpoint_summary(table).first()
    assert summary.baseline_start_utc == "2026-04-23T08:00:00Z" and summary.comparison_end_utc == "2026-04-30T08:10:00Z"
    one = table.filter("next_stop_point_ref = '20'")
    assert change.midpoint_summary(one).count() == 0 and change.midpoint_change(one).count() == 0


def test_explicit_change_orders_and_city_parts(spark):
    table = written(spark, report_tables(spark))
    periods = change.explicit_periods("2026-04-23", "2026-04-24", "2026-04-30", "2026-05-01")
    assert periods.window == (utc("2026-04-22T21:00:00"), utc("2026-04-30T21:00:00"))
    parts = spark.createDataFrame([("10", "Centre")], "stop_id string, city_part string")
    row = change.stop_change(table, periods.label(), stops=feed_stops(spark), city_parts=parts).first()
    assert (row.stop_name, row.city_part, row.median_delay_change_min) == ("First feed", "Centre", 8.0)
    by_part = change.stop_change(table, periods.label(), city_parts=parts, group_by="city-part", sort_by="decrease")
    assert [(r.city_part, r.p90_delay_change_min) for r in by_part.collect()] == [("Centre", 8.0)]
    assert change.stop_change(table, periods.label(), min_observations=2).count() == 0
    for bad in ({"group_by": "city-part"}, {"sort_by": "name"}):
        with pytest.raises(ValueError):
            change.stop_change(table, periods.label(), **bad)


def test_period_bounds(spark):
    with pytest.raises(ValueError, match="all four"):
        change.explicit_periods("2026-04-23", None, "2026-04-30", "2026-05-01")
    with pytest.raises(ValueError, match="baseline"):
        change.explicit_periods("2026-04-24", "2026-04-23", "2026-04-30", "2026-05-01")
    rows = observations(spark, [observation(1, "2026-05-02T10:00:00", 0), observation(2, "2026-05-03T12:00:00", 0, stop=None)])
    periods = change.recent_periods(rows, 1)
    assert periods.comparison_end == utc("2026-05-02T10:00:01")
    assert periods.baseline_start == utc("2026-04-30T10:00:01") and periods.baseline_end == periods.comparison_start
    assert change.recent_periods(rows.filter("false")) is None
    with pytest.raises(ValueError):
        change.recent_periods(rows, 0)


def test_plain_keeps_whole_numbers(spark):
    row = plain(spark.sql("select true a, cast(1 as int) b, 1.23456789D c, date'2026-01-02' d")).first()
    assert tuple(row) == (1, 1, 1.234568, "2026-01-02")
