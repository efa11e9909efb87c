"""Exact percentiles of groups whose distinct values nothing bounds.

`metrics` keeps all distinct delays of a group in one percentile state. That is
right while delays are whole or half seconds within two hours; in the raw and
diagnostic modes a delay may be any double. Here the wanted ranks are searched
instead: a sketch cuts every group into ranges, the rows of each range are
counted, and only the ranges that hold a wanted rank are cut again, until each
has few distinct values. The sketch decides how fast that is, the counts decide
the result, so it is exact. No task holds more than a sketch, the counts of one
group's ranges, or one small range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from punctual.operators.metrics import (
    COUNT,
    DELAY,
    EARLY_QUANTILES,
    QUANTILES,
    earliest,
    metric_aggregates,
    metric_outputs,
)
from punctual.session import materialise

#: Ranges that a group is cut into, and distinct values that a range may keep.
PARTS = 64
MOST = 4_096
ACCURACY = 10_000


def same_group_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on the keys of a group, NULL being a value like any other."""
    other = right.withColumnsRenamed({key: f"_other_{key}" for key in keys})
    if not keys:
        return left.join(other, F.lit(True), how)  # One row on the right.
    on = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_other_{key}")) for key in keys])
    return left.join(other, on, how).drop(*[f"_other_{key}" for key in keys])


def positions(quantiles: Sequence[float]):
    return [(F.col("_total") - 1) * F.lit(float(q)) for q in quantiles]


def percentiles(
    histogram: DataFrame,
    keys: Sequence[str],
    quantiles: Sequence[float],
    *,
    value: str = DELAY,
    count: str = COUNT,
    alias: str = "percentiles",
    most: int = MOST,
) -> DataFrame:
    """(keys, array of the percentiles), as `percentile(value, quantiles, count)` gives them.

    NULL values do not count; a group without any other has no row. The driver
    reads one number a round, the largest range, and the rounds grow with the
    logarithm of the distinct values: three for 100 million of them.
    """
    if most < PARTS:
        raise ValueError(f"most must be at least {PARTS}")
    group = [*keys, "_segment"]
    known = histogram.filter(F.col(value).isNotNull())
    rows = materialise(
        known.groupBy(*keys, F.col(value).cast("double").alias("_value"))
        .agg(F.sum(count).alias("_count"))
        .filter(F.col("_count") > 0)
        .withColumn("_segment", F.lit(0).cast("long")),
        "selection_values",
    )
    totals = rows.groupBy(*keys).agg(F.sum("_count").alias("_total")).filter(F.col("_total") > 0)
    ranks = [f(p).cast("long") for p in positions(quantiles) for f in (F.floor, F.ceil)]
    rank = F.explode(F.array_distinct(F.array(*ranks))).alias("_rank")
    wanted = totals.select(*keys, F.lit(0).cast("long").alias("_segment"), rank).withColumn("_local", F.col("_rank"))
    wanted = materialise(wanted, "selection_ranks")
    while largest_range(rows, group) > most:
        rows, wanted = cut(rows, wanted, keys)
    upto = F.sum("_count").over(Window.partitionBy(*group).orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.withColumn("_upto", upto)
    found = same_group_join(wanted, ends, group).filter(
        (F.col("_local") >= F.col("_upto") - F.col("_count")) & (F.col("_local") < F.col("_upto"))
    )
    at = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))

    def interpolated(position):
        lower, higher = F.floor(position).cast("long"), F.ceil(position).cast("long")
        low, high = F.col("_at")[lower], F.col("_at")[higher]
        between = (higher - position) * low + (position - lower) * high
        return F.when((lower == higher) | (low == high), low).otherwise(between)

    return same_group_join(totals, at, keys).select(
        *keys, F.array(*[interpolated(p) for p in positions(quantiles)]).alias(alias)
    )


def largest_range(rows: DataFrame, group: Sequence[str]) -> int:
    """Distinct values of the largest range: one number."""
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    return sizes.agg(F.coalesce(F.max("_size"), F.lit(0)).alias("_size")).first()["_size"]


def cut(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Cut every range at its sketched quantiles; keep the parts with a wanted rank, and the ranks within them."""
    group = [*keys, "_segment"]
    steps = [i / PARTS for i in range(1, PARTS)]
    pivots = rows.groupBy(*group).agg(F.percentile_approx("_value", steps, ACCURACY).alias("_pivots"))
    part = F.size(F.filter("_pivots", lambda pivot: pivot < F.col("_value")))
    placed = same_group_join(rows, pivots, group).withColumn("_part", part).drop("_pivots")
    # At most PARTS rows a group from here on.
    sizes = placed.groupBy(*group, "_part").agg(F.sum("_count").alias("_inside"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_inside").over(earlier), F.lit(0)))
    local = F.col("_local") - F.col("_before")
    segment = (F.col("_segment") * PARTS + F.col("_part")).alias("_segment")
    inside = same_group_join(wanted, sizes, group).filter((local >= 0) & (local < F.col("_inside")))
    inside = materialise(inside.select(*keys, segment, "_rank", local.alias("_local")), "selection_ranks")
    kept = placed.select(*keys, "_value", "_count", segment)
    kept = same_group_join(kept, inside.select(*group).distinct(), group, "left_semi")
    return materialise(kept, "selection_values"), inside


def wide_metrics(
    histogram: DataFrame,
    keys: Sequence[str],
    *,
    min_observations: int = 1,
    first: Mapping[str, str] | None = None,
    most: int = MOST,
) -> DataFrame:
    """The metric set of `metrics.histogram_metrics` where the distinct delays of a group have no bound.

    Pass a written histogram: counts, late and early percentiles each read it.
    """
    first = dict(first or {})
    scalars = {n: a for n, a in metric_aggregates().items() if n not in ("_quantiles", "_early")}
    totals = histogram.groupBy(*keys).agg(
        *[a.alias(name) for name, a in scalars.items()],
        *[earliest(source).alias(f"_first_{name}") for name, source in first.items()],
    )
    ahead = histogram.filter(F.col(DELAY) < 0).withColumn(DELAY, -F.col(DELAY))
    late = percentiles(histogram, keys, QUANTILES, alias="_quantiles", most=most)
    early = percentiles(ahead, keys, EARLY_QUANTILES, alias="_early", most=most)
    enough = totals.filter(F.col("bucket_count") >= min_observations)
    joined = same_group_join(same_group_join(enough, late, keys, "left"), early, keys, "left")
    return joined.select(*keys, *[F.col(f"_first_{name}").alias(name) for name in first], *metric_outputs())
