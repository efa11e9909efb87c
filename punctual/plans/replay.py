"""Stored polls replayed as a stream: in slices of time, some polls late, some twice."""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame, functions as F

from punctual.session import application_folder
from punctual.streaming import polls

SLICES = 20
#: A poll of LATE comes a slice late, one of TWICE comes again in the slice after.
LATE, TWICE = 11, 7


def new_folder(df: DataFrame, name: str) -> str:
    return f"{application_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


class Replay:
    """Rows that arrive in a folder, slice by slice; rows without a time come in the first one.

    Polls come at most three slices after others of their time, which is the stream's `lateness`.
    """

    def __init__(self, rows: DataFrame, time: str, slices: int = SLICES) -> None:
        self._spark, self.schema, self.slices = rows.sparkSession, rows.schema, slices
        self.folder, stage = new_folder(rows, "replay"), new_folder(rows, "slices")
        low, high = (v or 0 for v in rows.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first())
        width = (high - low) // slices + 1
        self.lateness = f"{3 * width // 1_000_000 + 1} seconds"
        at = F.coalesce(F.floor((F.unix_micros(time) - F.lit(low)) / F.lit(width)), F.lit(0)).cast("int")
        at = at + (F.col("id") % LATE == 0).cast("int")
        times = F.when(F.col("id") % TWICE == 0, F.array(at, at + 1)).otherwise(F.array(at))
        arriving = rows.withColumn("slice", F.explode(times))
        arriving.write.partitionBy("slice").parquet(stage)
        self._stored = self._spark.read.schema(arriving.schema).parquet(stage)
        self._next = 0

    def deliver(self, until: int | None = None) -> Replay:
        """Write the slices before `until`, or all; files are as old as their slice says."""
        until = self.slices + 2 if until is None else until
        for number in range(self._next, until):
            part = self._stored.filter(F.col("slice") == number).drop("slice")
            part.write.mode("append").parquet(self.folder)
        self._next = until
        return self

    def stream(self) -> DataFrame:
        """What has been delivered, in about as many batches as there were slices."""
        files = len(self._spark.read.schema(self.schema).parquet(self.folder).inputFiles())
        return polls.arriving(self._spark, self.folder, self.schema, max(1, -(-files // max(self._next, 1))))
