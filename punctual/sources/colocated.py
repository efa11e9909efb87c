"""Observations and polls stored by poll, so that their join moves neither.

Both tables have the same number of buckets over (poll, part). A poll stands in
every part, its observations are spread over the parts, so a poll that holds a
third of all rows does not lie in one bucket. Observations without a poll, which
meet nothing, are spread over all buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from punctual.operators.quality import POLL_PART

PARTS = 8


def write_colocated(
    observations: DataFrame, polls: DataFrame, root: str, name: str, buckets: int | None = None, parts: int = PARTS
) -> tuple[DataFrame, DataFrame]:
    """Write `<name>_observations` and `<name>_polls` as bucketed tables with their files below `root`.

    They are tables of the session's catalogue, as buckets are known there only.
    Polls keep their id and collection time, once for each part.
    """
    spark = observations.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = F.xxhash64("id")
    part = F.when(F.col("poll_id").isNull(), spread).otherwise(F.pmod(spread, F.lit(parts)))
    all_parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    tables = {
        "observations": (observations.withColumn(POLL_PART, part.cast("long")), "poll_id"),
        "polls": (polls.select("id", "collected_at_utc", all_parts.alias(POLL_PART)), "id"),
    }
    for kind, (table, key) in tables.items():
        # Shuffled by what the buckets are made of, so that a bucket is one file.
        placed = table.repartition(buckets, key, POLL_PART).write.mode("overwrite").format("parquet")
        placed.option("path", f"{root}/{kind}").bucketBy(buckets, key, POLL_PART).saveAsTable(f"{name}_{kind}")
    return spark.table(f"{name}_observations"), spark.table(f"{name}_polls")


def write_poll_times(polls: DataFrame, root: str, name: str, buckets: int) -> DataFrame:
    """Write the table `name`, ids and collection times of polls, bucketed by id, with its files in `root`.

    For joins that come again and again, as one in every batch of a stream: the polls are neither worked
    out nor shuffled again there, if `buckets` are no fewer than that query's shuffle partitions.
    """
    timed = polls.filter(F.col("id").isNotNull()).select("id", "collected_at_utc")
    placed = timed.repartition(buckets, "id").write.mode("overwrite").format("parquet")
    placed.option("path", root).bucketBy(buckets, "id").saveAsTable(name)
    return polls.sparkSession.table(name)
