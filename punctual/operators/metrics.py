"""The delay metric set, computed from delay histograms.

A group may hold a third of all rows, and an exact percentile needs its whole
distribution. So rows are first counted per (group, delay): plain hash
aggregation that combines before its shuffle and whose shuffle key includes the
delay, so no task receives a whole hot group. The percentiles are then taken
over (delay, count) pairs. Accepted delays are whole or half seconds within two
hours, so a group has at most 28,801 of them however many rows it holds. Where
nothing bounds them, `selection.wide_metrics` gives the same set.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from punctual.schemas import METRIC_COLUMNS

DELAY = "delay_seconds"
COUNT = "bucket_count"
POLLS = "raw_poll_count"
SEEN = "_first_seen"
QUANTILES = [0.5, 0.75, 0.9, 0.95]
EARLY_QUANTILES = [0.5, 0.9]


def delay_histogram(rows: DataFrame, keys: Sequence[str], names: Sequence[str] = ()) -> DataFrame:
    """Count rows and polls per (keys, names, delay).

    `rows` are buckets or a finer histogram of them. `names` are descriptive
    columns of which the earliest is wanted later; as grouping columns they
    keep every aggregate in a fixed-width buffer.
    """
    present = rows.columns
    polls = F.col(POLLS) if POLLS in present else F.lit(1)
    columns = list(dict.fromkeys([*keys, *names, DELAY]))
    aggregates = [
        (F.sum(COUNT) if COUNT in present else F.count(F.lit(1))).alias(COUNT),
        F.coalesce(F.sum(polls), F.lit(0)).cast("long").alias(POLLS),
    ]
    if names:
        aggregates.append(F.min(SEEN if SEEN in present else "representative_time_utc").alias(SEEN))
    return rows.groupBy(*columns).agg(*aggregates)


def earliest(name: str, seen: str = SEEN) -> Column:
    """The non-NULL value seen first; ties go to the smallest value."""
    value = F.col(name)
    return F.min_by(value, F.when(value.isNotNull(), F.struct(F.col(seen).isNull(), F.col(seen), value)))


def metric_aggregates() -> dict[str, Column]:
    """Aggregates over histogram rows; `_late` and `_early` are percentile arrays."""
    delay, count = F.col(DELAY), F.col(COUNT)

    def share(condition: Column) -> Column:
        return F.sum(F.when(condition, count).otherwise(F.lit(0))) / F.sum(count) * 100.0

    known = F.sum(F.when(delay.isNotNull(), count).otherwise(F.lit(0)))
    return {
        "bucket_count": F.coalesce(F.sum(count), F.lit(0)),
        "raw_poll_count": F.coalesce(F.sum(POLLS), F.lit(0)),
        "avg_delay_min": F.try_divide(F.sum(delay * count), known) / 60.0,
        "_quantiles": F.percentile(delay, QUANTILES, count),
        "pct_late": share(delay > 0),
        "pct_over_3_min_late": share(delay > 180),
        "pct_over_5_min_late": share(delay > 300),
        "pct_early": share(delay < 0),
        "pct_over_1_min_early": share(delay < -60),
        "pct_over_3_min_early": share(delay < -180),
        "_early": F.percentile(F.when(delay < 0, -delay), EARLY_QUANTILES, count),
    }


def metric_outputs(prefix: str = "") -> list[Column]:
    derived = {
        "signed_mean_delay_min": F.col("avg_delay_min"),
        "median_delay_min": F.col("_quantiles")[0] / 60.0,
        "p75_delay_min": F.col("_quantiles")[1] / 60.0,
        "p90_delay_min": F.col("_quantiles")[2] / 60.0,
        "p95_delay_min": F.col("_quantiles")[3] / 60.0,
        "median_early_min_abs": F.coalesce(F.col("_early")[0] / 60.0, F.lit(0.0)),
        "p90_early_min_abs": F.coalesce(F.col("_early")[1] / 60.0, F.lit(0.0)),
    }
    return [derived.get(c, F.col(c)).alias(prefix + c) for c in METRIC_COLUMNS]


def histogram_metrics(
    histogram: DataFrame,
    keys: Sequence[str],
    *,
    min_observations: int = 1,
    first: Mapping[str, str] | None = None,
    distinct: Mapping[str, str] | None = None,
    prefix: str = "",
) -> DataFrame:
    """Metric set per key from histogram rows; no keys give one overall row."""
    first, distinct = dict(first or {}), dict(distinct or {})
    aggregates = [a.alias(name) for name, a in metric_aggregates().items()]
    aggregates += [earliest(source).alias(f"_first_{name}") for name, source in first.items()]
    aggregates += [F.count_distinct(source).alias(f"_distinct_{name}") for name, source in distinct.items()]
    return (
        histogram.groupBy(*keys)
        .agg(*aggregates)
        .filter(F.col("bucket_count") >= min_observations)
        .select(
            *keys,
            *[F.col(f"_first_{name}").alias(name) for name in first],
            *[F.col(f"_distinct_{name}").alias(name) for name in distinct],
            *metric_outputs(prefix),
        )
    )


def summarize_delay_metrics(
    rows: DataFrame,
    keys: Sequence[str] = (),
    *,
    min_observations: int = 1,
    first: Mapping[str, str] | None = None,
    distinct: Mapping[str, str] | None = None,
    prefix: str = "",
) -> DataFrame:
    """Metric set of `rows` per key; `first` and `distinct` map output to source column."""
    counted_apart = [*keys, *(distinct or {}).values()]
    return histogram_metrics(
        delay_histogram(rows, counted_apart, list((first or {}).values())),
        keys,
        min_observations=min_observations,
        first=first,
        distinct=distinct,
        prefix=prefix,
    )


def sort_robust(metrics: DataFrame, ties: Sequence[str], limit: int | None = None, ascending: bool = False) -> DataFrame:
    """Highest p90 first, then the larger late share, then the smaller group."""
    worst, smaller = (F.asc, F.desc) if ascending else (F.desc, F.asc)
    ordered = metrics.orderBy(worst("p90_delay_min"), worst("pct_over_5_min_late"), smaller("bucket_count"), *ties)
    return ordered.limit(limit) if limit is not None else ordered
