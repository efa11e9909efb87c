"""Streams against the batch operators: late and repeated polls, closed hours, alarms, restarts."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from punctual.operators import buckets, collector, dashboard, quality
from punctual.plans import catalogue
from punctual.plans.adapter import tables
from punctual.plans.replay import Replay, new_folder
from punctual.plans.tables import Tables
from punctual.schemas import POLL_SCHEMA
from punctual.streaming import polls as streams
from tests.conftest import utc

SF = "/root/testdata/sf0.001"
START = utc("2024-01-01T00:00:00")


def drained(stream, name="stream", folder=None):
    folder = folder or new_folder(stream, name)
    return streams.drain(stream, f"{folder}/rows", f"{folder}/checkpoint")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def driver(spark):
    return tables(spark, SF)


def test_late_and_repeated_polls_count_once(driver):
    replay = Replay(driver.polls, "attempted_at_utc").deliver()
    stream = replay.stream()
    found, progress = drained(streams.once(stream, "attempted_at_utc", replay.lateness))
    assert rows_of(found) == rows_of(driver.polls)
    arrived = sum(p.numInputRows for p in progress)
    assert arrived > driver.polls.count() and sum(p.numInputRows > 0 for p in progress) >= 10
    # Ids are forgotten when none of their polls can come any more: the state does not grow with the stream.
    kept = [p.stateOperators[0].numRowsTotal for p in progress]
    assert max(kept) < driver.polls.count() / 2 and kept[-1] < driver.polls.count() / 3
    assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in progress) == 0


def test_rows_without_a_key_or_a_time(spark):
    at = utc("2024-01-01T10:00:00")
    rows = [(None, at, "a"), (None, at, "a"), (None, at, "b"), (1, at, "a"), (1, at, "c"), (2, None, "d")]
    folder = new_folder(spark.range(1), "keys")
    batch = spark.createDataFrame(rows, "id long, at timestamp, what string").coalesce(1)
    batch.write.parquet(folder)
    found, _ = drained(streams.once(streams.arriving(spark, folder, batch.schema), "at", "1 hour"))
    got = [(r.id, r.what) for r in found.collect()]
    assert sorted(got, key=repr) == [(1, "a"), (None, "a"), (None, "b")]


def test_a_restart_loses_and_repeats_nothing(driver):
    replay, folder = Replay(driver.observations, "created_at_utc"), new_folder(driver.observations, "quality")
    counts = []
    for until in (7, 14, None):
        arrived = streams.once(replay.deliver(until).stream(), "created_at_utc", replay.lateness)
        found, _ = drained(streams.flagged(arrived, driver.polls, mode="diagnostic"), folder=folder)
        counts.append(found.count())
    assert 0 < counts[0] < counts[1] < counts[2]
    wanted = quality.quality_rows(driver.observations, driver.polls, mode="diagnostic").select(*found.columns)
    assert rows_of(found) == rows_of(wanted)


def test_closed_hours_have_the_batch_metrics(driver):
    replay = Replay(driver.observations, "created_at_utc").deliver()
    flagged = streams.flagged(replay.stream(), driver.polls)
    found, progress = drained(streams.hour_histogram(flagged, replay.lateness))
    rows = buckets.bucketable(quality.quality_rows(driver.observations, driver.polls))
    latest = rows.agg(F.max("representative_time_utc")).first()[0]
    mark = latest.replace(microsecond=latest.microsecond // 1000 * 1000) - timedelta(seconds=int(replay.lateness.split()[0]))
    hour = F.date_trunc("hour", "representative_time_utc")
    closed = rows.where(hour + F.expr("INTERVAL 1 HOUR") <= F.lit(mark))
    assert 0 < closed.count() < rows.count()
    batch = dashboard.line_hour_metrics(buckets.delay_buckets(closed, "poll"))
    assert rows_of(dashboard.line_hour_metrics(streams.with_hour_calendar(found))) == rows_of(batch)
    # Hours and lines share no state row between batches that are further apart than the polls come late.
    assert all(p.stateOperators[0].numRowsTotal < rows.count() for p in progress)


def test_state_follows_the_cores_not_the_shuffles(spark, driver):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        replay = Replay(driver.polls, "attempted_at_utc", 3).deliver()
        found, progress = drained(streams.once(replay.stream(), "attempted_at_utc", replay.lateness))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {p.stateOperators[0].numShufflePartitions for p in progress} == {max(8, spark.sparkContext.defaultParallelism)}
    assert rows_of(found) == rows_of(driver.polls)


def test_polls_written_once_are_not_moved_in_a_batch(spark, driver):
    known = driver.polls.unionByName(driver.polls.limit(2).withColumn("id", F.lit(None).cast("long")))
    known = known.unionByName(driver.polls.where("id % 10 = 4"))
    stored = catalogue.poll_times(Tables(driver.observations, polls=known))
    hinted = driver.observations.hint("merge")
    plan = quality.quality_rows(hinted, stored)._jdf.queryExecution().sparkPlan().toString()
    prepared = quality.quality_rows(hinted, stored)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and prepared.count("Exchange hashpartitioning") == 1
    wanted = quality.quality_rows(driver.observations, known)
    assert rows_of(quality.quality_rows(driver.observations, stored)) == rows_of(wanted)


def polls_of(rng, source, n):
    at, rows = START, []
    for _ in range(n):
        at += timedelta(seconds=rng.choice([20, 60, 60, 60, 60, 61, 119, 120, 121, 122, 300, 4000]), microseconds=rng.randrange(1000))
        ok = rng.random() < 0.7
        rows.append((source, at, at + timedelta(seconds=rng.choice([0, 1])) if ok else None, rng.choice(["ok", "empty"]) if ok else "error", int(ok)))
    return rows


def test_alarms_are_the_gaps_at_a_fixed_cadence(spark):
    rng = random.Random(3)
    rows = polls_of(rng, "a", 300) + polls_of(rng, None, 150) + polls_of(rng, "b", 40)
    # A success and a failure at one time; the success counts first.
    rows += [("c", START, START, "ok", 1), ("c", START + timedelta(seconds=500), None, "error", 0)]
    rows += [("c", START + timedelta(seconds=500), START + timedelta(seconds=500), "ok", 1)]
    rng.shuffle(rows)
    schema = "source string, attempted_at_utc timestamp, collected_at_utc timestamp, status string, ok int, id long"
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)
    table = table.withColumn("row_count", F.lit(1.0))
    replay = Replay(table, "attempted_at_utc", 6).deliver()
    found, _ = drained(streams.cadence_alarms(replay.stream(), 60, replay.lateness))
    at = F.coalesce("collected_at_utc", "attempted_at_utc")
    latest = table.agg(F.max(at)).first()[0]
    mark = latest.replace(microsecond=latest.microsecond // 1000 * 1000) - timedelta(seconds=int(replay.lateness.split()[0]))
    gaps = collector.success_gaps(table, cadence_seconds=60).where(F.col("gap_end_utc") < F.lit(mark))
    columns = ["source", "gap_start_utc", "gap_end_utc", F.col("gap_seconds").cast("long"), "failed_attempt_count", "next_success_status"]
    closed = found.where("state = 'closed'")
    assert rows_of(closed.select(columns)) == rows_of(gaps.select(columns))
    assert closed.count() > 30 and closed.where("source is null").count() > 5
    # Every gap was raised once, and so was the silence of sources that have no later poll.
    raised = found.where("state = 'open'").select("source", "gap_start_utc")
    assert raised.count() == raised.distinct().count()
    assert closed.select("source", "gap_start_utc").exceptAll(raised).isEmpty()
    assert found.where("state = 'open' and source = 'c'").count() == 2
    assert {f.name for f in POLL_SCHEMA} >= {"source", "status", "ok"}
