from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from punctual.operators import quality, selection
from punctual.operators.metrics import delay_histogram, histogram_metrics
from punctual.sources.colocated import write_colocated
from tests.conftest import utc
from tests.fixtures import observation, observations
from punctual.schemas import POLL_SCHEMA

QUANTILES = [0.0, 0.1, 0.5, 0.75, 0.9, 0.95, 1.0]


def as_spark_gives_them(histogram, keys):
    found = histogram.groupBy(*keys).agg(F.percentile("delay_seconds", QUANTILES, F.col("bucket_count")).alias("p"))
    return {tuple(r[:-1]): r[-1] for r in found.collect() if r[-1] is not None}


def test_percentiles_equal_the_whole_distribution(spark):
    """Groups cut over several rounds: a hot one, a NULL one, one value, clusters, heavy counts, no value."""
    rng = random.Random(5)
    rows = [("hot", rng.gauss(0, 1e3), rng.randrange(1, 4)) for _ in range(20_000)]
    rows += [(None, rng.random() * 10 ** rng.randrange(-9, 9), 1) for _ in range(3_000)]
    rows += [("one", 4.25, 7), ("none", None, 3), ("heavy", 1.0, 10**9), ("heavy", 2.0, 1), ("two", 1.0, 1), ("two", 2.0, 1)]
    rows += [("close", 1.0 + i * 2.0**-50, 1) for i in range(2_000)]
    table = spark.createDataFrame(rows, "line_ref string, delay_seconds double, bucket_count long").repartition(8)
    found = selection.percentiles(table, ["line_ref"], QUANTILES, most=64)
    assert {(r.line_ref,): r.percentiles for r in found.collect()} == as_spark_gives_them(table, ["line_ref"])


def test_without_keys_and_without_rows(spark):
    table = spark.range(5_000).select((F.col("id") * 0.37).alias("delay_seconds"), F.lit(2).alias("bucket_count"))
    whole = selection.percentiles(table, [], QUANTILES, most=64)
    assert [r.percentiles for r in whole.collect()] == list(as_spark_gives_them(table, []).values())
    assert selection.percentiles(table.filter("false"), [], QUANTILES).count() == 0
    with pytest.raises(ValueError, match="most"):
        selection.percentiles(table, [], QUANTILES, most=1)


def test_wide_metrics_equal_the_metric_set(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["3", "4", None]), "n", rng.gauss(60, 300), 1, utc("2026-04-23T08:00:00")) for _ in range(3_000)]
    rows += [("late", "n", 60.5, 1, utc("2026-04-23T08:00:00"))]
    columns = "line_ref string, published_line_name string, delay_seconds double, raw_poll_count long, representative_time_utc timestamp"
    counted = delay_histogram(spark.createDataFrame(rows, columns), ["line_ref"], ["published_line_name"])
    first = {"line_name": "published_line_name"}
    wide = selection.wide_metrics(counted, ["line_ref"], first=first, most=64)
    plain = histogram_metrics(counted, ["line_ref"], first=first)
    assert wide.columns == plain.columns
    expected = {r.line_ref: r for r in plain.collect()}
    for row in wide.collect():
        assert list(row)[2:] == pytest.approx(list(expected.pop(row.line_ref))[2:])
    assert not expected


def test_colocated_tables_meet_without_a_shuffle(spark, tmp_path):
    """A hot poll, an unknown one and none: the rows of the plain join, no exchange, no bucket with all of a poll."""
    rows = [observation(i, "2026-04-23T08:00:00", 60, poll=(7, 7, None, i, 10**6 + i)[i % 5]) for i in range(400)]
    polls = [(i, "a", utc("2026-04-23T08:00:00"), utc("2026-04-23T08:00:10"), "ok", 1, 1.0, None) for i in range(400)]
    seen, known = observations(spark, rows), spark.createDataFrame(polls, POLL_SCHEMA)
    stored = write_colocated(seen, known, str(tmp_path), "colocated_test", buckets=4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = quality.quality_rows(*stored)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        expected = quality.quality_rows(seen, known)
        assert joined.columns == expected.columns
        assert sorted(map(repr, joined.collect())) == sorted(map(repr, expected.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    hot = stored[0].filter("poll_id = 7").groupBy("poll_part").count()
    assert hot.count() == 8 and hot.agg(F.max("count")).first()[0] < 60
    for kind in ("observations", "polls"):
        spark.sql(f"DROP TABLE colocated_test_{kind}")
