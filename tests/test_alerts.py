from __future__ import annotations

import random
from datetime import timedelta
from pathlib import Path
from urllib.parse import unquote

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctual.functions.times import with_local_calendar
from punctual.operators import alerts
from punctual.schemas import ALERT_SCHEMA
from punctual.session import materialise
from tests.conftest import utc
from tests.fixtures import observation, observations

START = utc("2026-04-23T00:00:00")


def alert(id="a", line="3", cause="works", effect="delay", priority=1, active=1, start="2026-04-23T08:00:00",
          end="2026-04-23T10:00:00", routes=None, stops=None, created="2026-04-20T00:00:00"):
    return (id, line, cause, effect, priority, active, start and utc(start), end and utc(end), routes, stops, utc(created))


def make(spark, *rows):
    return spark.createDataFrame(list(rows), ALERT_SCHEMA)


def bounds():
    return F.lit(utc("2026-04-23T00:00:00")), F.lit(utc("2026-04-25T00:00:00"))


def test_targets(spark):
    table = make(
        spark,
        alert(cause=" ", effect=None, priority=None, routes='["3", "7", null]', stops='["10", "10"]'),
        alert("b", line=None, start=None, end=None, routes="broken"),
        alert("c", line="9", start=None, end=None),
        alert("off", active=0),
    )
    found = alerts.alert_targets(alerts.active_alerts(table), None, *bounds()).collect()
    mine = {(r.alert_scope, r.target_ref) for r in found if r.cause == "Unknown"}
    assert mine == {("route", "3"), ("route", "7"), ("stop", "10")}
    assert {(r.effect, r.priority) for r in found if r.cause == "Unknown"} == {("Unknown", -1)}
    open_ended = next(r for r in found if r.target_ref == "9")
    assert open_ended.start_utc.day == 20 and open_ended.end_utc.microsecond == 1
    assert len(found) == 4
    assert alerts.alert_targets(table, None, *bounds(), kind="stop").count() == 1
    with pytest.raises(ValueError):
        alerts.alert_targets(table, None, *bounds(), kind="train")


def test_overlap_filter(spark):
    table = make(spark, alert("in"), alert("late", start="2026-04-24T00:00:00", end=None), alert("old", end="2026-04-23T08:30:00"))
    kept = alerts.active_alerts(table, utc("2026-04-23T09:00:00"), utc("2026-04-24T00:00:00"))
    assert [r.source_alert_id for r in kept.collect()] == ["in"]


def test_window_rules(spark):
    rows = observations(spark, [observation(1, "2026-05-02T10:00:00", 0), observation(2, "2026-05-03T12:00:00", 0, line="4")])
    assert alerts.analysis_window(rows) == (utc("2026-05-01T12:00:01"), utc("2026-05-03T12:00:01"))
    assert alerts.analysis_window(rows, line="3")[1] == utc("2026-05-02T10:00:01")
    assert alerts.analysis_window(rows, start="2026-05-01", days=1)[1] == utc("2026-05-01T21:00:00")
    assert alerts.analysis_window(rows, end="2026-05-01", days=1)[0] == utc("2026-04-29T21:00:00")
    assert alerts.analysis_window(rows, full_history=True) == (None, None)
    assert alerts.analysis_window(rows.filter("false")) == (None, None)
    for bad in ({"days": 0}, {"start": "2026-05-02", "end": "2026-05-01"}):
        with pytest.raises(ValueError):
            alerts.analysis_window(rows, **bad)


COLUMNS = (
    "bucket_id string, line_ref string, direction_ref string, next_stop_point_ref string, delay_seconds double,"
    " raw_poll_count long, published_line_name string, representative_time_utc timestamp"
)


def bucket_table(spark, rows):
    return with_local_calendar(spark.createDataFrame(rows, COLUMNS), "representative_time_utc")


def test_controls_share_the_context(spark):
    at = utc("2026-04-23T08:30:00")
    rows = [
        ("1", "3", "1", "10", 60.0, 1, "3", at),
        ("2", "3", "1", "10", 120.0, 2, "3", at + timedelta(days=1)),
        ("3", "3", "2", "10", 180.0, 1, "3", at + timedelta(days=1)),
    ]
    table = bucket_table(spark, rows)
    active = alerts.alert_active(table, make(spark, alert()), None)
    controls = alerts.control_histogram(table, active)
    assert [(r.delay_seconds, r.bucket_count, r.raw_poll_count) for r in controls.collect()] == [(120.0, 1, 2)]
    row = alerts.alert_lift(active, controls).first()
    assert (row.bucket_count_alert, row.bucket_count_control, row.median_delay_lift_min) == (1, 1, -1.0)
    line = alerts.alert_lift(active, controls, by_line=True).first()
    assert (line.line_ref, line.line_name) == ("3", "3")
    assert alerts.alert_lift(active, controls, min_observations=2).count() == 0


def test_bounds_are_inclusive_and_overlaps_count_once(spark):
    table = bucket_table(
        spark,
        [(str(i), "3", "1", "10", 60.0, 1, "3", utc(t)) for i, t in enumerate(
            ["2026-04-23T08:00:00", "2026-04-23T10:00:00", "2026-04-23T10:00:01", "2026-04-24T00:00:00"])],
    )
    once = make(spark, alert("a"), alert("b", start="2026-04-23T07:00:00", end="2026-04-23T10:00:00"))
    assert alerts.alert_active(table, once, None).agg(F.sum("bucket_count")).first()[0] == 2
    overnight = make(spark, alert(end="2026-04-24T00:00:00"), alert("b", start="2026-04-24T00:00:00", end=None))
    assert alerts.alert_active(table, overnight, None).agg(F.sum("bucket_count")).first()[0] == 4


def brute_force(rows, table):
    """Active and control delays per group by nested loops."""
    groups = {}
    for a in table:
        targets = ([("route", a[1])] if a[1] else []) + ([("stop", a[9][2:-2])] if a[9] else [])
        for scope, target in targets:
            groups.setdefault((a[2], a[3], a[4], scope), []).append((target, a[6], a[7]))
    result = {}
    for group, intervals in groups.items():
        column = 1 if group[3] == "route" else 3
        is_active = [any(r[column] == t and s <= r[7] <= e for t, s, e in intervals) for r in rows]
        contexts = {r[8:] for r, a in zip(rows, is_active) if a}
        active = [r[4] for r, a in zip(rows, is_active) if a]
        controls = [r[4] for r, a in zip(rows, is_active) if not a and r[8:] in contexts]
        if active and controls:
            result[group] = (active, controls)
    return result


def test_against_brute_force(spark):
    rng = random.Random(11)
    rows = [
        (str(i), rng.choice("345"), rng.choice("12"), rng.choice(["10", "20", None]), rng.randrange(-300, 900) / 1.0,
         rng.randrange(1, 4), "n", START + timedelta(minutes=rng.randrange(0, 6 * 24 * 60)))
        for i in range(500)
    ]
    table = []
    for i in range(25):
        start = START + timedelta(minutes=rng.randrange(-1000, 6 * 24 * 60))
        end = start + timedelta(minutes=rng.choice((30, 300, 2000, 4320)))
        table.append((str(i), rng.choice(["3", "4", None]), rng.choice("XY"), "E", rng.randrange(2), 1, start, end, None,
                      rng.choice([None, '["10"]', '["20"]']), START))
    buckets = bucket_table(spark, rows)
    calendar = {r.bucket_id: (r.line_ref, r.direction_ref, r.local_hour, r.day_type) for r in buckets.collect()}
    expected = brute_force([(*r, *calendar[r[0]]) for r in rows], table)
    active = alerts.alert_active(buckets, spark.createDataFrame(table, ALERT_SCHEMA), None)
    found = alerts.alert_lift(active, alerts.control_histogram(buckets, active), limit=None).collect()
    assert {(r.cause, r.effect, r.priority, r.alert_scope) for r in found} == set(expected)
    for r in found:
        a, c = expected[r.cause, r.effect, r.priority, r.alert_scope]
        assert (r.bucket_count_alert, r.bucket_count_control) == (len(a), len(c))
        assert r.p90_delay_min_alert == pytest.approx(np.quantile(a, 0.9) / 60)
        assert r.median_delay_min_control == pytest.approx(np.median(c) / 60)


def test_size_of_the_cells_decides_the_join(spark):
    """Few written cells are broadcast, many are merged; nothing is forced."""
    table = materialise(bucket_table(spark, [("1", "3", "1", "10", 60.0, 1, "3", utc("2026-04-23T08:30:00"))]), "buckets")
    few = materialise(alerts.day_cells(alerts.alert_targets(make(spark, alert()), None, *bounds()), *bounds()), "few")
    keys = [c for c in few.columns if c not in ("target_ref", "cause")]
    many = materialise(
        few.crossJoin(spark.range(400_000)).select(
            F.sha2(F.col("id").cast("string"), 256).alias("target_ref"), F.sha1(F.col("id").cast("string")).alias("cause"), *keys
        ).repartition(4),
        "many",
    )
    plans = [alerts.active_buckets(table, cells)._jdf.queryExecution().executedPlan().toString() for cells in (few, many)]
    assert "BroadcastHashJoin" in plans[0]
    # The one bucket may be broadcast, on the left; the many cells, on the right, never are.
    assert "BuildRight" in plans[0]
    assert "BuildRight" not in plans[1]


def test_only_alerted_days_are_opened(spark):
    """Buckets with a folder per local day: the cells' days decide which folders are read."""
    rows = [
        (str(i), "3", "1", "10", 60.0, 1, "3", utc("2026-04-20T08:30:00") + timedelta(days=i)) for i in range(10)
    ]
    table = materialise(bucket_table(spark, rows), "buckets", by_day="local_date")
    two = make(spark, alert(), alert("b", start="2026-04-27T08:00:00", end="2026-04-27T10:00:00"))
    cells = materialise(alerts.day_cells(alerts.alert_targets(two, None, *bounds()), F.lit(START - timedelta(days=3)),
                                         F.lit(START + timedelta(days=7))), "cells")
    found = alerts.active_buckets(table, cells)
    # Files of other days are unreadable now: opening one would fail.
    for file in table.inputFiles():
        day = int(unquote(file).split("local_date=2026-04-")[1][:2])
        if day not in (23, 27):
            Path(unquote(file).removeprefix("file:")).write_bytes(b"no parquet")
    assert sorted(r.representative_time_utc.day for r in found.collect()) == [23, 27]
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()


def test_intervals_merge_over_midnight_before_they_are_cut(spark):
    table = make(
        spark,
        alert("a", start="2026-04-23T08:00:00", end="2026-04-23T23:00:00"),
        alert("b", start="2026-04-23T09:00:00", end="2026-04-24T02:00:00"),
        alert("c", start="2026-04-24T02:00:00", end="2026-04-24T03:00:00"),
        alert("d", start="2026-04-24T05:00:00", end="2026-04-24T06:00:00"),
    )
    cells = alerts.day_cells(alerts.alert_targets(table, None, *bounds()), *bounds(), "UTC").orderBy("start_utc").collect()
    assert [(r.start_utc.isoformat(), r.end_utc.isoformat()) for r in cells] == [
        ("2026-04-23T08:00:00", "2026-04-24T00:00:00"),
        ("2026-04-24T00:00:00", "2026-04-24T03:00:00"),
        ("2026-04-24T05:00:00", "2026-04-24T06:00:00"),
    ]
