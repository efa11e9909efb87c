from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from punctual.operators import buckets, quality
from punctual.schemas import QUALITY_FLAGS
from tests.conftest import dicts, utc
from tests.fixtures import observation, observations, quality_sample, report_tables


def test_each_row_raises_its_flag(spark):
    rows = {r["id"]: r for r in dicts(quality.with_quality_flags(quality_sample(spark)))}
    raised = {i: [f for f in QUALITY_FLAGS if r[f]] for i, r in rows.items()}
    assert raised.pop(2) == ["is_implausible_delay", "has_stop_call_disagreement"]
    assert raised == {1: [], **{i + 2: [flag] for i, flag in enumerate(QUALITY_FLAGS) if i}}
    assert rows[3]["observation_age_seconds"] == 630 and rows[6]["stop_call_delay_diff_seconds"] == 840.0


@pytest.mark.parametrize(
    "mode, strict, kept",
    [("conservative", False, [1, 6]), ("conservative", True, [1]), ("raw", True, [1, 2, 3, 4, 5, 6]),
     ("diagnostic", False, [1, 2, 3, 4, 5, 6])],
)
def test_quality_modes(spark, mode, strict, kept):
    flagged = quality.with_quality_flags(quality_sample(spark))
    passed = quality.with_quality_pass(flagged, mode, strict).filter("quality_pass")
    assert sorted(r.id for r in passed.select("id").collect()) == kept


def test_unknown_mode_and_thresholds(spark):
    flagged = quality.with_quality_flags(quality_sample(spark), max_abs_delay_seconds=9000, stale_seconds=700)
    with pytest.raises(ValueError):
        quality.with_quality_pass(flagged, "lenient")
    assert flagged.filter("is_implausible_delay").count() == 0


def test_missing_times_raise_no_flag(spark):
    bare = spark.createDataFrame([(1, 60.0, "3")], "id long, delay_seconds double, line_ref string")
    row = quality.with_quality_flags(bare).first()
    assert row.quality_issue_count == 0


def test_thresholds_are_strict(spark):
    sample = quality_sample(spark).filter("id = 1")
    at_limit = sample.withColumn("delay_seconds", F.lit(7200.0)).withColumn(
        "next_expected_arrival_time_utc", F.lit(utc("2026-04-23T10:15:00"))
    )
    row = quality.with_quality_flags(at_limit).first()
    assert not row.is_implausible_delay and not row.has_stop_call_disagreement


def test_summary_by_line_and_examples(spark):
    rows = quality.with_quality_pass(quality.with_quality_flags(quality_sample(spark)))
    counts = quality.quality_counts(rows)
    summary = {r["quality_check"]: (r["row_count"], round(r["pct_rows"], 3)) for r in dicts(quality.quality_summary(counts))}
    assert summary["analysis_rows"] == (6, 100.0)
    assert summary["conservative_excluded_default"] == (4, 66.667)
    assert summary["conservative_excluded_with_stop_call_disagreement"] == (5, 83.333)
    line = quality.quality_by_line(counts).first()
    assert (line.line_ref, line.line_name, line.row_count, line.conservative_excluded_rows) == ("3", "3", 6, 4)
    assert quality.quality_by_line(counts, min_observations=7).count() == 0
    assert [r.id for r in quality.quality_examples(rows, 3).collect()] == [2, 4, 3]
    assert quality.quality_summary(quality.quality_counts(rows.filter("false"))).count() == 0


def test_base_filter_and_absent_polls(spark):
    tables = report_tables(spark)
    joined = quality.analysis_rows(tables.observations, tables.polls)
    assert joined.filter("collected_at_utc is not null").count() == 5
    alone = quality.quality_rows(tables.observations)
    assert alone.count() == 5 and alone.filter("collected_at_utc is not null").count() == 0
    assert quality.analysis_rows(tables.observations.withColumn("is_gtfs_matchable", F.lit(0))).count() == 0


def test_three_polls_make_one_bucket(spark):
    rows = quality_sample(spark).filter("id <= 3").withColumn(
        "delay_seconds", F.expr("cast(id * 60 as double)")
    ).withColumn("collected_at_utc", F.col("created_at_utc").cast("timestamp"))
    bucket = buckets.delay_buckets(rows).collect()
    assert len(bucket) == 1
    assert (bucket[0].raw_poll_count, bucket[0].delay_seconds, bucket[0].delay_min) == (3, 120.0, 2.0)
    assert (bucket[0].local_hour, bucket[0].day_type, bucket[0].local_weekday) == (11, "weekday", 3)
    assert bucket[0].bucket_id == "3|1|a|v1|3|1|10"


def test_null_keys_group_together_and_names_skip_null(spark):
    rows = [
        observation(1, "2026-04-23T08:00:00", 10, trip=None, stop=None, name=None, direction=None),
        observation(2, "2026-04-23T08:01:00", 20, trip=None, stop=None, name="Later", direction=None),
    ]
    row = buckets.delay_buckets(observations(spark, rows)).first()
    assert (row.bucket_id, row.direction_ref, row.raw_poll_count) == ("<NA>|v1|3|Unknown|<NA>", "Unknown", 2)
    assert (row.delay_seconds, row.next_stop_point_name) == (15.0, "Later")


def test_recorded_time_may_be_missing(spark):
    rows = [observation(1, None, 300, aimed="2026-04-24T00:01:00")]
    row = buckets.delay_buckets(quality.quality_rows(observations(spark, rows))).first()
    assert (row.raw_poll_count, row.delay_seconds, row.recorded_at_utc) == (1, 300.0, None)


def test_window_applies_before_bucketing(spark):
    rows = observations(
        spark, [observation(1, "2026-04-23T23:59:00", 60), observation(2, "2026-04-24T00:01:00", 600)]
    )
    selected = quality.select_rows(
        quality.quality_rows(rows), start=utc("2026-04-24T00:00:00"), end=utc("2026-04-25T00:00:00")
    )
    found = buckets.delay_buckets(selected).collect()
    assert [(r.raw_poll_count, r.delay_seconds) for r in found] == [(1, 600.0)]


def test_other_bucket_modes(spark):
    tables = report_tables(spark)
    rows = quality.quality_rows(tables.observations, tables.polls)
    polls = buckets.delay_buckets(rows, "poll")
    assert sorted(r.bucket_id for r in polls.collect()) == ["1", "2", "3", "4"]
    trips = buckets.delay_buckets(rows, "vehicle-trip")
    assert {r.bucket_id: r.raw_poll_count for r in trips.collect()}["trip-baseline|v1|3|1"] == 2
    hours = buckets.delay_buckets(rows, "line-hour")
    assert "3|1|2026-04-23|11|weekday" in {r.bucket_id for r in hours.collect()}
    with pytest.raises(ValueError):
        buckets.delay_buckets(rows, "hour")


def test_daylight_saving_follows_the_zone(spark):
    rows = [observation(i, t, 0, trip=str(i)) for i, t in enumerate(["2026-03-28T22:30:00", "2026-03-29T02:30:00"])]
    found = buckets.delay_buckets(observations(spark, rows)).orderBy("representative_time_utc").collect()
    assert [(str(r.local_date), r.local_hour) for r in found] == [("2026-03-29", 0), ("2026-03-29", 5)]


def test_one_bucket_may_hold_most_polls(spark):
    rng = random.Random(5)
    delays = [rng.randrange(-900, 1800) for _ in range(401)]
    rows = [observation(i, "2026-04-23T08:00:00", d, trip=None) for i, d in enumerate(delays)]
    rows += [observation(1000 + i, "2026-04-23T09:00:00", 60 * i, trip=f"t{i}") for i in range(5)]
    found = {r.bucket_id: r for r in buckets.delay_buckets(observations(spark, rows)).collect()}
    hot = found["<NA>|v1|3|1|10"]
    assert (hot.raw_poll_count, hot.delay_seconds) == (401, statistics.median(delays))
    assert found["t3|v1|3|1|10"].delay_seconds == 180.0


def test_hot_bucket_is_counted_per_delay_before_its_own_shuffle(spark):
    rows = observations(spark, [observation(1, "2026-04-23T08:00:00", 60)])
    plan = buckets.delay_buckets(rows)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2 and "delay_seconds" not in exchanges[0] and "delay_seconds" in exchanges[1]
