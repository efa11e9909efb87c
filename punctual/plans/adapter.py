"""Canonical transit tables derived from the driver's event tables.

The driver has no vehicle data, so every event stands for one vehicle poll; its
integer `k` (0-99) picks the line, the stop and which quality fault it shows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from punctual.functions.times import seconds_between
from punctual.operators.collector import with_previous_success
from punctual.session import configure


# The driver's column layouts; giving them saves a footer job per read.
DRIVER_SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def text(column: Column) -> Column:
    return column.cast("string")


def pick() -> Column:
    return F.col("k")


def seen() -> Column:
    return F.col("r")


def after(seconds) -> Column:
    seconds = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.timestamp_micros(F.unix_micros(seen()) + seconds.cast("long") * 1_000_000)


def every(modulus: int, remainder: int) -> Column:
    return pick() % modulus == remainder


def events(raw: DataFrame) -> DataFrame:
    """Events with `k`, the one number in `props` (`{"k": n}`), and their time, to the microsecond.

    Filters on derived columns are pushed to the scan with the extraction
    inside them, several times per row: text search is five times cheaper there
    than parsing JSON.
    """
    number = F.substring_index(F.substring_index("props", ":", -1), "}", 1)
    return raw.withColumns(
        {
            "k": number.try_cast("int"),
            "r": F.col("ts").cast("timestamp"),
        }
    )


def observations(event_rows: DataFrame) -> DataFrame:
    aimed = F.when(~every(10, 9), seen())
    delay = F.floor(F.col("value") * 10) - 300 + F.when(every(100, 99), 9000).otherwise(0)
    late_call = F.when(every(15, 4), 900).otherwise(0)
    return event_rows.select(
        F.col("event_id").alias("id"),
        # Some polls have several observations, some observations an unknown poll.
        F.when(every(17, 5), None)
        .when(every(19, 3), -F.col("event_id") - 1)
        .when(every(4, 0), F.col("event_id") - F.col("event_id") % 2)
        .otherwise(F.col("event_id"))
        .alias("poll_id"),
        text(F.col("user_id")).alias("vehicle_id"),
        F.when(~every(41, 8), seen()).alias("recorded_at_utc"),
        after(90).alias("valid_until_utc"),
        F.concat(F.lit("L"), text(pick() % 12)).alias("line_ref"),
        F.when(~every(50, 0), text(1 + pick() % 2)).alias("direction_ref"),
        after(F.when(every(20, 3), 1800).otherwise(-300)).alias("origin_aimed_departure_time_utc"),
        F.concat_ws("|", text(F.col("user_id")), F.date_format(F.date_trunc("week", seen()), "yyyy-MM-dd")).alias(
            "trip_match_key"
        ),
        (F.col("event_type") != "error").cast("int").alias("is_gtfs_matchable"),
        F.when(~every(30, 1), F.concat(F.lit("Line "), text(pick() % 12))).alias("published_line_name"),
        delay.cast("double").alias("delay_seconds"),
        F.when(~every(60, 7), text(pick() % 8)).alias("next_stop_point_ref"),
        F.when(~every(16, 9), F.concat(F.lit("Stop "), text(pick() % 8))).alias("next_stop_point_name"),
        aimed.alias("next_aimed_arrival_time_utc"),
        F.when(aimed.isNotNull(), after(delay + late_call)).alias("next_expected_arrival_time_utc"),
        F.lit(None).cast("timestamp").alias("next_aimed_departure_time_utc"),
        F.lit(None).cast("timestamp").alias("next_expected_departure_time_utc"),
        after(F.when(every(20, 11), -3600).otherwise(3600)).alias("destination_aimed_arrival_time_utc"),
        after(45).alias("created_at_utc"),
    )


def collector_polls(event_rows: DataFrame) -> DataFrame:
    """Polls without the recorded gap; reading one row per poll needs no window."""
    ok = ~every(10, 0)
    return event_rows.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("source"),
        seen().alias("attempted_at_utc"),
        F.when(ok, after(F.when(every(25, 7), 600).otherwise(30))).alias("collected_at_utc"),
        F.when(ok, "ok").otherwise("error").alias("status"),
        ok.cast("int").alias("ok"),
        F.when(ok, pick().cast("double")).alias("row_count"),
    )


def polls_with_gaps(polls: DataFrame) -> DataFrame:
    """The collector's own gap column, seconds since the source's previous success, and that success."""
    gap = F.when(F.col("ok") == 1, seconds_between("_previous_success", "collected_at_utc"))
    return with_previous_success(polls).withColumn(
        "gap_seconds_since_previous_success", gap.cast("double")
    )


def service_alerts(event_rows: DataFrame) -> DataFrame:
    routes = F.concat(F.lit('["R'), text(pick() % 12), F.lit('", null, {"x":1}]'))
    return event_rows.filter(F.col("event_type") == "error").select(
        F.concat(F.lit("alert-"), text(F.col("event_id"))).alias("source_alert_id"),
        F.when(every(2, 0), F.concat(F.lit("L"), text(pick() % 12))).alias("line_ref"),
        F.when(~every(11, 0), F.concat(F.lit("C"), text(pick() % 3))).alias("cause"),
        F.concat(F.lit("E"), text(pick() % 2)).alias("effect"),
        F.when(~every(13, 0), pick() % 4).alias("priority"),
        F.when(every(45, 5), 0).otherwise(1).alias("is_active"),
        F.when(~every(35, 10), seen()).alias("validity_start_utc"),
        F.when(~every(35, 0), after(6 * 3600)).alias("validity_end_utc"),
        F.when(every(25, 0), "not json").otherwise(routes).alias("affected_routes_json"),
        F.concat(F.lit('["'), text(pick() % 8), F.lit('"]')).alias("affected_stops_json"),
        seen().alias("created_at_utc"),
    )


# The two feed dates of the synthetic timetable.
FEEDS = (("2024-01-08", ""), ("2024-01-20", " v2"))


def per_feed(nations: DataFrame) -> DataFrame:
    feeds = F.array(*[F.struct(F.to_date(F.lit(d)).alias("gtfs_feed_date"), F.lit(s).alias("suffix")) for d, s in FEEDS])
    return nations.withColumn("feed", F.explode(feeds)).select("*", "feed.*")


def gtfs_stops(nations: DataFrame) -> DataFrame:
    """Every nation is a stop; 7 has no name and 5 and 7 no place, so fallbacks are met."""
    key = F.col("n_nationkey")
    located = ~key.isin(5, 7)
    return per_feed(nations).select(
        "gtfs_feed_date",
        text(key).alias("stop_id"),
        F.when(key != 7, F.concat("n_name", "suffix")).alias("gtfs_stop_name"),
        F.when(located, 60.0 + key / 100.0).alias("stop_lat"),
        F.when(located, 22.0 + key / 50.0).alias("stop_lon"),
    )


def gtfs_routes(nations: DataFrame) -> DataFrame:
    key = F.col("n_nationkey")
    short = F.when(F.col("suffix") == "", key).otherwise((key + 1) % 12)
    return per_feed(nations).select(
        "gtfs_feed_date",
        F.concat(F.lit("R"), text(key)).alias("route_id"),
        F.concat(F.lit("L"), text(short)).alias("route_short_name"),
    )


def city_parts(nations: DataFrame, regions: DataFrame) -> DataFrame:
    key = F.col("n_nationkey")
    mapped = nations.join(regions, nations.n_regionkey == regions.r_regionkey)
    return mapped.select(text(key).alias("stop_id"), F.when(key != 6, F.col("r_name")).alias("city_part"))


class DriverTables:
    """The tables of `Tables`, each put together when a query first asks for it."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._sf_dir = spark, sf_dir

    def _read(self, name: str) -> DataFrame:
        return self._spark.read.schema(DRIVER_SCHEMAS[name]).parquet(f"{self._sf_dir}/{name}.parquet")

    @cached_property
    def observations(self) -> DataFrame:
        return observations(events(self._read("events")))

    @cached_property
    def polls(self) -> DataFrame:
        return collector_polls(events(self._read("events")))

    @cached_property
    def alerts(self) -> DataFrame:
        return service_alerts(events(self._read("events")))

    @cached_property
    def stops(self) -> DataFrame:
        return gtfs_stops(self._read("nation"))

    @cached_property
    def routes(self) -> DataFrame:
        return gtfs_routes(self._read("nation"))

    @cached_property
    def city_parts(self) -> DataFrame:
        return city_parts(self._read("nation"), self._read("region"))


def tables(spark: SparkSession, sf_dir: str) -> DriverTables:
    return DriverTables(configure(spark), sf_dir)
