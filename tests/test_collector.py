from __future__ import annotations

import random
from datetime import timedelta

import pytest

from punctual.operators import collector
from punctual.schemas import POLL_SCHEMA
from tests.conftest import dicts, utc
from tests.fixtures import report_tables

START = utc("2026-04-23T00:00:00")


def poll(id, source, minute, ok=1, rows=10.0, gap=None, collected=True):
    at = START + timedelta(minutes=minute)
    return (id, source, at, at if collected else None, "ok" if ok else "error", ok, rows if ok else None, gap)


def test_report_fixture_has_one_blackout_and_one_spot(spark):
    polls = report_tables(spark).polls
    blackout = collector.collector_blackouts(polls).collect()
    assert [(r.source, r.blackout_count, r.expected_cadence_seconds) for r in blackout] == [("siri_vm", 1, 600.0)]
    gaps = collector.success_gaps(polls)
    spot = collector.missing_spots(gaps).first()
    assert (spot.gap_start_utc, spot.gap_end_utc) == ("2026-04-23T08:01:00Z", "2026-04-30T08:00:30Z")
    assert spot.missing_min == pytest.approx((604770 - 600) / 60)
    assert collector.missing_summary(polls, gaps).first().missing_spot_count == 1


def test_failures_strictly_inside_and_sources_without_gaps(spark):
    rows = [poll(i, "a", i, gap=60.0) for i in range(5)]
    rows += [poll(10, "a", 4.5, ok=0), poll(11, "a", 6, ok=0), poll(12, "a", 7, ok=0), poll(13, "a", 14, ok=0)]
    rows += [poll(20, "a", 14, gap=600.0), poll(30, "b", 1, ok=0)]
    polls = spark.createDataFrame(rows, POLL_SCHEMA)
    gaps = collector.success_gaps(polls)
    spots = collector.missing_spots(gaps).collect()
    assert [(r.source, r.gap_min, r.missing_min, r.failed_attempt_count) for r in spots] == [("a", 10.0, 9.0, 3)]
    summary = {r["source"]: r for r in dicts(collector.missing_summary(polls, gaps))}
    assert summary["b"] == {"source": "b", "poll_count": 1, "success_count": 0, "failed_count": 1,
                            "missing_spot_count": 0, "total_missing_min": 0.0, "largest_missing_min": 0.0,
                            "estimated_missed_polls": 0.0, "estimated_missed_rows": 0.0}
    assert collector.success_gaps(polls, gap_multiplier=10).count() == 0
    assert collector.success_gaps(polls, min_missing_minutes=9.5).count() == 0
    assert collector.collector_blackouts(polls).count() == 2
    assert [r.id for r in collector.collector_polls(polls, "b").collect()] == [30]


def test_previous_success_equals_a_plain_scan(spark):
    """Slices with carry give what a scan over each whole source gives."""
    rng = random.Random(3)
    rows = [
        poll(i, rng.choice("ab"), rng.randrange(0, 60 * 30) + rng.choice((0, 0.5)), rng.random() < 0.6)
        for i in range(400)
    ]
    rows = [(*r[:5], int(r[5]), *r[6:]) for r in rows]
    polls = spark.createDataFrame(rows, POLL_SCHEMA)
    found = {r.id: r["_previous_success"] for r in collector.with_previous_success(polls).collect()}
    expected = {}
    for source in "ab":
        last = None
        mine = sorted((r for r in rows if r[1] == source), key=lambda r: (r[2], -r[5], r[0]))
        for row in mine:
            expected[row[0]] = last
            last = row[2] if row[5] else last
    assert {k: v and v.timestamp() for k, v in found.items()} == {k: v and v.timestamp() for k, v in expected.items()}


def test_a_null_source_is_a_source(spark):
    """Blackouts, gaps and the summary agree on polls without a source, and on polls without a time."""
    rows = [poll(i, None, i, gap=60.0) for i in range(5)] + [poll(9, None, 30, gap=1560.0)]
    rows += [poll(100 + i, None, 0, collected=False) for i in range(20)]
    polls = spark.createDataFrame(rows, POLL_SCHEMA)
    blackout = collector.collector_blackouts(polls).first()
    gaps = collector.success_gaps(polls)
    summary = collector.missing_summary(polls, gaps).first()
    assert (blackout.source, blackout.blackout_count, gaps.count(), summary.missing_spot_count) == (None, 1, 1, 1)
    assert collector.with_previous_success(polls).filter("id >= 100 and _previous_success is not null").count() == 0


def test_polls_are_followed_in_two_scans(spark, tmp_path):
    """Polls without a time are no scan of their own, and each is alone in its window partition."""
    rows = [poll(i, "ab"[i % 2], i, gap=120.0) for i in range(40)]
    rows += [poll(100 + i, "a", 0, collected=False) for i in range(40)]
    spark.createDataFrame(rows, POLL_SCHEMA).write.parquet(str(tmp_path / "polls"))
    followed = collector.with_previous_success(spark.read.schema(POLL_SCHEMA).parquet(str(tmp_path / "polls")))
    plan = followed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 2 and plan.count("Window [") == 2
    found = {r.id: r["_previous_success"] for r in followed.collect()}
    assert len(found) == 80 and all(found[100 + i] is None for i in range(40))
    assert all(found[i] is not None for i in range(2, 40))
