"""Date-versioned stop and route metadata."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from punctual.schemas import DEFAULT_TIMEZONE

def feed_calendar(metadata: DataFrame) -> DataFrame:
    """(local_date, gtfs_feed_date): the feed in force on every day before the newest feed.

    The as-of join becomes an equality join on the day. There is one row per day
    between the first feed and the last, whatever the data size; from the last
    feed's own date on no table is needed.
    """
    feeds = metadata.filter(F.col("gtfs_feed_date").isNotNull()).agg(
        F.sort_array(F.collect_set("gtfs_feed_date")).alias("feeds")
    )
    spans = feeds.select("feeds", F.posexplode("feeds").alias("position", "gtfs_feed_date")).select(
        "gtfs_feed_date", F.get("feeds", F.col("position") + 1).alias("next_feed")
    )
    days = F.sequence("gtfs_feed_date", F.date_sub("next_feed", 1))
    return spans.filter(F.col("next_feed").isNotNull()).select(F.explode(days).alias("local_date"), "gtfs_feed_date")


def feed_for_day(feeds: list[date], day: date) -> date | None:
    """Same rule for one day and a feed listing held by the driver."""
    return max((feed for feed in feeds if feed <= day), default=None)


def with_feed_date(rows: DataFrame, metadata: DataFrame, day: str = "local_date") -> DataFrame:
    """Add the newest feed not after `day`; NULL before the first feed."""
    calendar = feed_calendar(metadata).withColumnRenamed("local_date", day)
    newest = metadata.agg(F.max("gtfs_feed_date")).scalar()
    joined = rows.drop("gtfs_feed_date").join(calendar, day, "left")
    current = F.when(F.col(day) >= newest, newest).otherwise(F.col("gtfs_feed_date"))
    return joined.withColumn("gtfs_feed_date", current)


def first_per_key(metadata: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by `order`, then by value."""
    values = [c for c in metadata.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in [*order, *[v for v in values if v not in order]]])
    picked = metadata.groupBy(*keys).agg(F.min_by(F.struct(*values), rank).alias("_first"))
    return picked.select(*keys, *[F.col(f"_first.{v}").alias(v) for v in values])


def with_stop_metadata(rows: DataFrame, stops: DataFrame | None) -> DataFrame:
    """Join stop name and coordinates by feed date and stop, or by stop for one forced feed.

    The join carries no hint: stops are broadcast while their size allows, and
    otherwise AQE splits the rows of a busy stop.
    """
    rows = rows.withColumn("stop_id", F.col("next_stop_point_ref")).drop(
        "gtfs_feed_date", "gtfs_stop_name", "stop_lat", "stop_lon", "stop_name", "has_gtfs_stop_metadata"
    )
    if stops is None:
        joined = rows.withColumns(
            {
                "gtfs_feed_date": F.lit(None).cast("date"),
                "gtfs_stop_name": F.lit(None).cast("string"),
                "stop_lat": F.lit(None).cast("double"),
                "stop_lon": F.lit(None).cast("double"),
            }
        )
    elif "gtfs_feed_date" in stops.columns:
        unique = first_per_key(
            stops.select("gtfs_feed_date", "stop_id", "gtfs_stop_name", "stop_lat", "stop_lon"),
            ["gtfs_feed_date", "stop_id"],
            [],
        )
        joined = with_feed_date(rows, unique).join(unique, ["gtfs_feed_date", "stop_id"], "left")
    else:
        unique = first_per_key(stops.select("stop_id", "gtfs_stop_name", "stop_lat", "stop_lon"), ["stop_id"], [])
        joined = rows.withColumn("gtfs_feed_date", F.lit(None).cast("date")).join(unique, "stop_id", "left")
    return joined.withColumns(
        {
            "has_gtfs_stop_metadata": F.col("gtfs_stop_name").isNotNull(),
            "stop_name": F.coalesce("gtfs_stop_name", "next_stop_point_name"),
        }
    )


def with_city_part(rows: DataFrame, city_parts: DataFrame | None) -> DataFrame:
    if city_parts is None:
        return rows.withColumn("city_part", F.lit(None).cast("string"))
    return rows.join(first_per_key(city_parts.select("stop_id", "city_part"), ["stop_id"], []), "stop_id", "left")


def stop_coverage(rows_with_metadata: DataFrame) -> DataFrame:
    return rows_with_metadata.agg(
        F.count(F.lit(1)).alias("bucket_count"),
        F.count_if(~F.col("has_gtfs_stop_metadata")).alias("unmatched_gtfs_count"),
    )


def resolve_route_names(
    refs: DataFrame,
    routes: DataFrame | None,
    *,
    route: str = "route_ref",
    at: str = "start_utc",
    timezone: str = DEFAULT_TIMEZONE,
    alias: str = "target_ref",
) -> DataFrame:
    """Short name of each route in the feed in force at `at`; the raw id when unknown."""
    if routes is None:
        return refs.withColumn(alias, F.col(route))
    if "gtfs_feed_date" not in routes.columns:
        names = first_per_key(routes.select(F.col("route_id").alias(route), "route_short_name"), [route], [])
        joined = refs.join(names, route, "left")
    else:
        names = first_per_key(
            routes.select("gtfs_feed_date", F.col("route_id").alias(route), "route_short_name"),
            ["gtfs_feed_date", route],
            [],
        )
        dated = refs.withColumn("_day", F.to_date(F.from_utc_timestamp(F.col(at), timezone)))
        joined = with_feed_date(dated, names, "_day").join(names, ["gtfs_feed_date", route], "left")
        joined = joined.drop("_day", "gtfs_feed_date")
    return joined.withColumn(alias, F.coalesce("route_short_name", route)).drop("route_short_name")
