from __future__ import annotations

import random
from datetime import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctual.functions.times import boundary, is_rush, rush_windows
from punctual.functions.values import json_scalars, natural_key, round_doubles
from punctual.operators import dashboard, metrics, rankings
from tests.conftest import dicts, utc

BUCKET = (
    "line_ref string, direction_ref string, local_hour int, day_type string, local_minutes int, is_weekday boolean,"
    " delay_seconds double, raw_poll_count long, published_line_name string, representative_time_utc timestamp,"
    " next_stop_point_ref string"
)


def bucket(line="3", delay=0.0, hour=8, direction="1", weekday=True, polls=1, name=None, seen="2026-04-23T08:00:00", stop="10"):
    kind = "weekday" if weekday else "weekend"
    return (line, direction, hour, kind, hour * 60, weekday, float(delay), polls, name or line, utc(seen), stop)


def test_metric_set(spark):
    data = [("3", float(d), p) for d, p in zip((-240, -120, 0, 240, 600), (1, 2, 1, 3, 4))]
    rows = spark.createDataFrame(data, "line_ref string, delay_seconds double, raw_poll_count long")
    row = metrics.summarize_delay_metrics(rows, ["line_ref"]).first()
    assert (row.bucket_count, row.raw_poll_count, row.median_delay_min) == (5, 11, 0.0)
    assert row.p90_delay_min == pytest.approx(7.6)
    assert (row.pct_over_3_min_late, row.pct_over_5_min_late, row.pct_over_3_min_early) == (40.0, 20.0, 20.0)
    assert (row.median_early_min_abs, row.signed_mean_delay_min) == (3.0, 1.6)
    assert metrics.summarize_delay_metrics(rows, ["line_ref"], min_observations=6).count() == 0
    assert metrics.summarize_delay_metrics(rows, prefix="alert_").first().alert_bucket_count == 5
    assert metrics.summarize_delay_metrics(rows.filter("false")).count() == 0


def test_polls_default_to_one_and_no_early_rows(spark):
    rows = spark.createDataFrame([("3", 60.0), ("3", 120.0)], "line_ref string, delay_seconds double")
    row = metrics.summarize_delay_metrics(rows, ["line_ref"]).first()
    assert (row.raw_poll_count, row.p90_early_min_abs, row.pct_late) == (2, 0.0, 100.0)


def test_percentiles_match_numpy_and_the_cube_gives_the_same(spark):
    rng = random.Random(7)
    data = [
        bucket(rng.choice("ABC"), rng.randrange(-400, 1200) / 2, rng.randrange(24), rng.choice("12"), rng.random() < 0.7)
        for _ in range(600)
    ]
    rows = spark.createDataFrame(data, BUCKET)
    direct = {r["line_ref"]: r for r in dicts(rankings.line_metrics(rows))}
    for line in "ABC":
        delays = np.array([d[6] for d in data if d[0] == line]) / 60
        assert direct[line]["p95_delay_min"] == pytest.approx(np.quantile(delays, 0.95))
        assert direct[line]["p90_early_min_abs"] == pytest.approx(np.quantile(-delays[delays < 0], 0.9))
    cube = rankings.delay_cube(rows)

    def approximately(df):
        return [{k: pytest.approx(v) if isinstance(v, float) else v for k, v in r.items()} for r in dicts(df)]

    for build in (
        lambda d: rankings.line_metrics(d).orderBy("line_ref"),
        lambda d: rankings.context_metrics(d, limit=None),
        rankings.hourly_profile,
        rankings.rush_impact,
    ):
        assert dicts(build(cube)) == approximately(build(rows))


def test_late_and_early_order(spark):
    rows = spark.createDataFrame([bucket("3", 600), bucket("4", -240), bucket("10", 60)], BUCKET)
    lines = rankings.line_metrics(rows)
    assert [r.line_ref for r in rankings.late_lines(lines).collect()] == ["3", "10", "4"]
    assert rankings.early_lines(lines).first().line_ref == "4"
    both = rankings.line_rankings(lines, 1).collect()
    assert [(r.ranking, r.line_ref) for r in both] == [("late", "3"), ("early", "4")]


def test_ties_prefer_the_smaller_context_and_the_larger_late_line(spark):
    rows = spark.createDataFrame([bucket("1", 60), bucket("2", 60), bucket("2", 60)], BUCKET)
    assert rankings.context_metrics(rows).first().line_ref == "1"
    assert rankings.robust_lines(rows).first().line_ref == "1"
    assert rankings.late_lines(rankings.line_metrics(rows)).first().line_ref == "2"


def test_context_filters_and_hours(spark):
    rows = spark.createDataFrame([bucket("1", 60, 7), bucket("1", 120, 9, "2"), bucket("2", 60, 9, weekday=False)], BUCKET)
    assert [r.hour_local for r in rankings.hourly_profile(rows).collect()] == ["07:00", "09:00"]
    assert rankings.hourly_profile(rows, by="robust", limit=1).first().hour_local == "09:00"
    assert rankings.hourly_profile(rows, line="2").count() == 1
    found = rankings.context_metrics(rows, line="1", direction="2", day_type="weekday").collect()
    assert [(r.line_ref, r.hour_local) for r in found] == [("1", "09:00")]


def test_rush_needs_both_sides(spark):
    rows = spark.createDataFrame(
        [bucket("1", 300, 8), bucket("1", 60, 12), bucket("1", 900, 8, weekday=False), bucket("2", 60, 8)], BUCKET
    )
    found = rankings.rush_impact(rows).collect()
    assert [(r.line_ref, r.bucket_count_rush, r.bucket_count_non_rush) for r in found] == [("1", 1, 2)]
    assert found[0].rush_median_delay_lift_min == pytest.approx(5 - 8.0)


def test_rush_windows(spark):
    minutes = spark.createDataFrame([(m, w) for m in (419, 420, 539, 540, 1330, 30) for w in (True, False)],
                                    "local_minutes int, is_weekday boolean")
    assert [r.local_minutes for r in minutes.filter(is_rush()).collect()] == [420, 539]
    night = minutes.filter(is_rush(["22:00-01:00"], include_weekends=True))
    assert sorted({r.local_minutes for r in night.collect()}) == [30, 1330]
    for bad in (["07:00-07:00"], ["7-9"], ["25:00-26:00"]):
        with pytest.raises(ValueError):
            rush_windows(bad)


def test_boundary_is_local():
    assert boundary("2026-05-06").isoformat() == "2026-05-05T21:00:00+00:00"
    assert boundary("2026-05-06T00:00:00+00:00").isoformat() == "2026-05-06T00:00:00+00:00"


def test_natural_order(spark):
    names = spark.createDataFrame([(n,) for n in ("10A", "2", "N1", "10", "n0", "1")], "name string")
    assert [r.name for r in names.orderBy(natural_key("name")).collect()] == ["1", "2", "10", "10A", "n0", "N1"]
    long = spark.createDataFrame([("9" * 41,), ("1" * 45,), ("0" * 50 + "7",), ("8",)], "name string")
    assert [r.name for r in long.orderBy(natural_key("name")).collect()] == ["0" * 50 + "7", "8", "9" * 41, "1" * 45]


def test_settings_that_would_be_ignored_are_refused(spark):
    marked = spark.sql("select 'L1' line_ref, true is_rush")
    with pytest.raises(ValueError, match="already marked"):
        rankings.rush_impact(marked, windows=("07:00-08:00",))
    with pytest.raises(ValueError, match="already marked"):
        rankings.rush_impact(marked, include_weekends=True)
    with pytest.raises(ValueError, match="days must be one of"):
        dashboard.filter_buckets(marked, days="Holidays")


def test_json_scalars(spark):
    texts = ['["a", null, {"x": 1}, [2], 3, true, "b"]', "[]", "", None, "oops", '{"k": "v"}', '"a"', "7"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, refs string")
    found = json_scalars(rows, "refs", "ref").select("id", "ref").collect()
    assert sorted((r.id, r.ref) for r in found) == [(0, "3"), (0, "True"), (0, "a"), (0, "b")]


def test_round_doubles(spark):
    df = spark.createDataFrame([(1.23456, 5, "x")], "a double, b int, c string")
    assert round_doubles(df).first().asDict() == {"a": 1.23, "b": 5, "c": "x"}


def test_grid_has_24_hours(spark):
    rows = spark.createDataFrame([bucket("1", 60, 7), bucket("2", 120, 9), bucket("2", 120, 10)], BUCKET)
    grid = dashboard.line_hour_grid(dashboard.line_hour_metrics(rows))
    assert [f"h{h:02d}" in grid.columns for h in range(24)] == [True] * 24
    assert [(r.line_ref, r.h07, r.h09) for r in grid.collect()] == [("2", None, 2.0), ("1", 1.0, None)]
    counts = dashboard.line_hour_grid(dashboard.line_hour_metrics(rows), "bucket_count")
    assert counts.first().sort_metric == 2


def stops(spark):
    rows = [
        ("late", "Late", 60.4, 22.2, 10, 25, 2.0, 20.0), ("early", "Early", 60.5, 22.3, 5, 15, -3.0, 0.0),
        ("zero", "Zero", 60.6, 22.4, 4, 4, 0.0, 0.0), ("lost", "Lost", None, None, 8, 20, 4.0, 50.0),
    ]
    return spark.createDataFrame(
        rows, "stop_id string, stop_name string, stop_lat double, stop_lon double, bucket_count long,"
        " raw_poll_count long, p90_delay_min double, pct_over_3_min_late double"
    )


def test_heat_weights(spark):
    def weights(*options):
        return {r.stop_id: r.heat_weight for r in dashboard.heat_weights(stops(spark), *options).collect()}

    assert weights("p90_delay_min") == {"late": 20.0}
    assert weights("p90_delay_min", "early") == {"early": 15.0}
    assert weights("pct_over_3_min_late") == {"late": 2.0}
    assert weights("raw_poll_count") == {"late": 25.0, "early": 15.0, "zero": 4.0}
    for bad in (("p90_delay_min", "sideways"), ("unknown",)):
        with pytest.raises(ValueError):
            dashboard.heat_weights(stops(spark), *bad)


def test_heat_scale_and_markers(spark):
    weights = spark.createDataFrame([(float(w),) for w in (1, 4, 9, 100)], "heat_weight double")
    scaled = dashboard.heat_scale(weights, cutoff_quantile=0.5, response="sqrt").orderBy("heat_weight").collect()
    assert [r.shaped_weight for r in scaled] == [1.0, 2.0, 3.0, 10.0]
    assert scaled[0].intensity_max == pytest.approx(np.quantile([1, 2, 3, 10], 0.99))
    assert scaled[0].intensity_cutoff == 2.5
    assert dashboard.heat_scale(weights, cap_quantile=None).first().intensity_max == 100.0
    assert dashboard.heat_scale(weights, manual_cap=7).first().intensity_max == 7.0
    assert dashboard.heat_scale(weights.filter("false")).count() == 0
    for bad in ({"cap_quantile": 0}, {"cutoff_quantile": 1}, {"response": "cubic"}):
        with pytest.raises(ValueError):
            dashboard.heat_scale(weights, **bad)
    sizes = [r.marker_size for r in dashboard.marker_sizes(stops(spark)).orderBy("bucket_count").collect()]
    assert (sizes[0], sizes[-1]) == (9.0, 30.0)
    assert dashboard.marker_sizes(stops(spark).limit(1)).first().marker_size == 19.5
    extent = stops(spark).select(dashboard.colour_extent(stops(spark), "p90_delay_min").alias("e")).first().e
    assert extent == pytest.approx(np.quantile([2, 3, 4], 0.95))
    manual = stops(spark).select(dashboard.colour_extent(stops(spark), "p90_delay_min", 3.5, automatic=False).alias("e"))
    assert manual.first().e == 3.5


def test_selection_summary_of_nothing_is_zero(spark):
    rows = spark.createDataFrame([bucket()], BUCKET)
    assert set(dashboard.selection_summary(rows.filter("false")).first()) == {0}
    assert dashboard.selection_summary(rows).first().bucket_count == 1


def test_filters_reject_reversed_times(spark):
    rows = spark.createDataFrame([bucket(hour=h) for h in (7, 8, 9)], BUCKET)
    kept = dashboard.filter_buckets(rows, start_time=time(7, 0), end_time=time(8, 0))
    assert kept.count() == 2
    assert dashboard.filter_buckets(rows, start_time=time(0, 0), end_time=time(23, 59)).count() == 3
    with pytest.raises(ValueError):
        dashboard.filter_buckets(rows, start_time=time(9, 0), end_time=time(8, 0))


def test_one_pass_over_the_cube_equals_each_ranking(spark):
    rng = random.Random(11)
    rows = [
        (f"L{rng.randrange(4)}", rng.choice("12"), hour, day, hour * 60, day == "weekday", float(rng.randrange(-300, 900)), 1,
         f"Line {rng.randrange(3)}", utc("2026-04-23T08:00:00"), "10")
        for _ in range(400)
        for hour, day in [(rng.choice((7, 8, 12, 16)), rng.choice(("weekday", "weekend")))]
    ]
    cube = rankings.delay_cube(spark.createDataFrame(rows, BUCKET))
    parts = rankings.cube_parts(rankings.cube_metrics(cube, 5))

    def same(one, other):
        assert one.columns == other.columns
        assert [tuple(r) for r in one.collect()] == [tuple(r) for r in other.collect()]

    same(rankings.late_lines(parts["line"], 3), rankings.late_lines(rankings.line_metrics(cube, 5), 3))
    same(rankings.ranked_contexts(parts["context"], 9), rankings.context_metrics(cube, 5, 9))
    same(rankings.ordered_hours(parts["hour"]), rankings.hourly_profile(cube, 5))
    same(rankings.compared_rush(parts["rush"], 3), rankings.rush_impact(cube, 5, 3))
