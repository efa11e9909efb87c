"""Polls as they arrive: repeats, quality flags, hourly metrics and cadence alarms on streams.

Every function takes a streaming DataFrame and returns one, built from the batch operators wherever
these keep no state. State lives as long as the watermark says and has a fixed width a row: ids seen,
counts per (hour, line, delay), and per source the last success with the polls that may still be
overtaken by late ones. Results go to Parquet through a checkpoint, so that each row is in them once,
whatever restarts come between.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from punctual.functions.times import with_local_calendar
from punctual.operators import buckets, quality
from punctual.operators.collector import is_success
from punctual.schemas import DEFAULT_TIMEZONE, POLL_SCHEMA, conform


def arriving(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder as a stream, oldest first."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def state_partitions(spark: SparkSession) -> int:
    """Partitions of a stream's state: one for each core, 8 at least, and never more than a shuffle has.

    Each is a store of its own, with files to write for every batch however few rows came, so a number
    that suits a shuffle of all rows costs more than the rows of one batch.
    """
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(shuffled, max(8, spark.sparkContext.defaultParallelism))


def drain(stream: DataFrame, path: str, checkpoint: str) -> tuple[DataFrame, list]:
    """Append all that has arrived to a table; (the table, the progress of each batch).

    Another call with the same checkpoint goes on where this one ended. Read through the table's own
    log, files of batches that failed half-way do not count.
    """
    writer = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    # A query takes the settings as they are when it starts; its checkpoint keeps the partitions for good.
    spark, name = stream.sparkSession, "spark.sql.shuffle.partitions"
    shuffled = spark.conf.get(name)
    spark.conf.set(name, str(state_partitions(spark)))
    try:
        query = writer.start()
    finally:
        spark.conf.set(name, shuffled)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path), query.recentProgress


def once(stream: DataFrame, time: str, lateness: str, key: str = "id") -> DataFrame:
    """Rows without repeats: of those that arrive within `lateness` of each other, the first of each key.

    A row without a key repeats one of the same content. The state holds the keys of that time, not of the
    whole stream; rows without a time could never be forgotten and are left out.
    """
    content = F.xxhash64(*[F.col(c) for c in stream.columns if c != key]).cast("string")
    named = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), content)
    timed = stream.filter(F.col(time).isNotNull()).withColumn("_key", named).withWatermark(time, lateness)
    return timed.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def flagged(observations: DataFrame, polls: DataFrame | None = None, **options) -> DataFrame:
    """`quality.quality_rows` of observations as they arrive, with the polls known when their batch runs."""
    return quality.quality_rows(observations, polls, **options)


def hour_histogram(rows: DataFrame, lateness: str) -> DataFrame:
    """Polls of each closed hour counted per line and delay, repeats left out.

    `rows` have their quality columns; those that do not pass, or have no delay, line or time, are not
    counted. An hour closes when the watermark passes its end and is given out once. Percentiles are not
    kept in the state: they follow from these counts, and a delay's count is as wide for ten million polls
    as for one.
    """
    rows = once(buckets.bucketable(rows), "representative_time_utc", lateness)
    counted = rows.groupBy(
        F.window("representative_time_utc", "1 hour").alias("hour"), "line_ref", "published_line_name", "delay_seconds"
    ).agg(F.count(F.lit(1)).alias("bucket_count"), F.min("representative_time_utc").alias("_first_seen"))
    return counted.select(
        F.col("hour.start").alias("hour_start_utc"),
        "line_ref",
        "published_line_name",
        "delay_seconds",
        "bucket_count",
        F.col("bucket_count").alias("raw_poll_count"),
        "_first_seen",
    )


def with_hour_calendar(histogram: DataFrame, timezone: str = DEFAULT_TIMEZONE) -> DataFrame:
    """Closed hours with the local fields that the metric operators group by; zones are whole hours from UTC."""
    return with_local_calendar(histogram, "hour_start_utc", timezone)


_ALARM = (
    "source string, state string, gap_start_utc timestamp, gap_end_utc timestamp, gap_seconds long,"
    " failed_attempt_count long, next_success_status string"
)
#: The last success, failures since, whether its alarm was raised, and polls that late ones may still overtake.
_STATE = "last long, failures long, raised boolean, waiting string"


def _alarm_machine(limit_seconds: float):
    """Polls of one source in order of time, as far as the watermark is sure of it."""

    def second(micros: int) -> int:
        return micros // 1_000_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, failures, raised, waiting = state.get if state.exists else (None, 0, False, "[]")
        polls = [tuple(p) for p in json.loads(waiting)]
        if not state.hasTimedOut:
            for batch in batches:
                at, failed = batch["at_us"].tolist(), batch["failed"].tolist()
                polls += zip(at, failed, (None if pd.isna(s) else s for s in batch["status"]))
        # Successes stand before failures of the same time, and the smallest status before others.
        polls.sort(key=lambda p: (p[0], p[1], p[2] is None, p[2] or ""))
        sure = state.getCurrentWatermarkMs() * 1000
        out = []

        def alarm(kind: str, end: int | None, status: str | None) -> None:
            seconds, failed = (None, None) if end is None else (second(end) - second(last), failures)
            out.append((None if pd.isna(key[0]) else key[0], kind, last, end, seconds, failed, status))

        ready = sum(p[0] < sure for p in polls)
        for at, failed, status in polls[:ready]:
            if not failed:
                if last is not None and second(at) - second(last) > limit_seconds:
                    if not raised:
                        alarm("open", None, None)
                    alarm("closed", at, status)
                if last is None or at > last:
                    last, failures, raised = at, 0, False
            elif last is not None and at > last:
                failures += 1
        polls = polls[ready:]
        overdue = None if last is None or raised else (second(last) + int(limit_seconds) + 1) * 1_000_000
        if overdue is not None and overdue <= sure and not any(not p[1] and p[0] < overdue for p in polls):
            alarm("open", None, None)
            raised, overdue = True, None
        state.update((last, failures, raised, json.dumps(polls)))
        times = [polls[0][0]] if polls else []
        times += [overdue] if overdue is not None else []
        if times:
            state.setTimeoutTimestamp(max(min(times) // 1000, state.getCurrentWatermarkMs() + 1))
        names = [field.split()[0] for field in _ALARM.split(",")]
        found = pd.DataFrame(out, columns=names)
        for name in ("gap_start_utc", "gap_end_utc"):
            found[name] = pd.to_datetime(pd.array(found[name], dtype="Int64"), unit="us", utc=True)
        yield found.astype({"gap_seconds": "Int64", "failed_attempt_count": "Int64", "source": object})

    return run


def cadence_alarms(
    polls: DataFrame, cadence_seconds: float, lateness: str, gap_multiplier: float = 2.0
) -> DataFrame:
    """Sources that go without a success for more than the multiple of a fixed cadence; repeats count once.

    A row `open` comes when the watermark passes that time, without waiting for the next poll; a row
    `closed` when the next success has come, with the failures in between. Polls are taken in order of
    time (successes when collected, failures when attempted) once no late one can come before them, so
    `closed` rows are those of `collector.success_gaps` at that cadence. A source's state is its last
    success and the polls within `lateness`; polls of one source in one batch meet in one task.
    """
    typed = conform(polls, POLL_SCHEMA)
    at = F.when(is_success(), F.col("collected_at_utc")).otherwise(F.col("attempted_at_utc"))
    timed = typed.select(
        "id", "source", at.alias("at_utc"), (~is_success()).alias("failed"), "status", F.unix_micros(at).alias("at_us")
    )
    return (
        once(timed, "at_utc", lateness)
        .groupBy("source")
        .applyInPandasWithState(
            _alarm_machine(gap_multiplier * cadence_seconds),
            _ALARM,
            _STATE,
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
