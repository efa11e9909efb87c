"""Date-versioned timetable folders `gtfs_YYYY-MM-DD` and the city part mapping."""

from __future__ import annotations

from datetime import date
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from punctual.operators.stops import first_per_key
from punctual.schemas import ROUTE_SCHEMA, STOP_SCHEMA

FEED_FOLDER = r"^gtfs_(\d{4}-\d{2}-\d{2})$"
STOP_FIELDS = ("stop_id", "stop_name", "stop_lat", "stop_lon")
ROUTE_FIELDS = ("route_id", "route_short_name")


def feed_date(path: Column) -> Column:
    """Feed date of a file from its folder name; NULL for other folders."""
    folder = F.element_at(F.split(path, "/"), -2)
    return F.try_to_date(F.regexp_extract(folder, FEED_FOLDER, 1), "yyyy-MM-dd")


def discover_feeds(spark: SparkSession, root: str, required_file: str | None = None) -> DataFrame:
    """(gtfs_feed_date, gtfs_dir) of the feeds under `root`, oldest first; file contents are not read."""
    try:
        files = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", required_file or "*")
            .load(f"{root}/gtfs_*/*")
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "gtfs_feed_date date, gtfs_dir string")
    return (
        files.select(
            feed_date(F.col("path")).alias("gtfs_feed_date"), F.regexp_replace("path", "/[^/]*$", "").alias("gtfs_dir")
        )
        .filter(F.col("gtfs_feed_date").isNotNull())
        .distinct()
        .orderBy("gtfs_feed_date")
    )


def feed_list(spark: SparkSession, root: str, required_file: str | None = None) -> list[tuple[date, str]]:
    """The feed listing on the driver: one short row per published timetable."""
    return [tuple(row) for row in discover_feeds(spark, root, required_file).collect()]


def latest_feed(spark: SparkSession, root: str, required_file: str = "stops.txt") -> str | None:
    feeds = feed_list(spark, root, required_file)
    return feeds[-1][1] if feeds else None


def require_columns(df: DataFrame, required, source: str) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{source} is missing required column(s): {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, paths: str | list[str], required) -> DataFrame:
    """The required columns as text, with the feed date of each row's file and its position there."""
    table = spark.read.csv(paths, header=True, escape='"')
    source = paths if isinstance(paths, str) else paths[0]
    return require_columns(table, required, source).select(
        *required,
        feed_date(F.col("_metadata.file_path")).alias("gtfs_feed_date"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def files_by_header(spark: SparkSession, root: str, filename: str) -> dict[str, list[str]]:
    """The feeds' files by their first line: one short row per published timetable comes to the driver."""
    try:
        lines = spark.read.text(f"{root}/gtfs_*/{filename}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    firsts = (
        lines.select(
            "value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")
        )
        .filter((F.col("file_block_start") == 0) & feed_date(F.col("file_path")).isNotNull())
        .groupBy("file_path")
        .agg(F.min_by("value", "row").alias("header"))
    )
    found: dict[str, list[str]] = {}
    for path, header in sorted(map(tuple, firsts.collect())):
        found.setdefault(header.lstrip("\ufeff").strip(), []).append(unquote(path))
    return found


def read_feeds(spark: SparkSession, gtfs_dir, gtfs_root, filename: str, fields, key: str, empty) -> DataFrame:
    """One forced folder without a date, or all feeds with theirs; the first row per key.

    Feeds may order their columns differently: files of one header are one scan,
    however many they are.
    """
    if gtfs_dir is not None:
        table, keys = read_csv(spark, f"{gtfs_dir}/{filename}", fields).drop("gtfs_feed_date"), [key]
    else:
        groups = files_by_header(spark, gtfs_root, filename)
        if not groups:
            return spark.createDataFrame([], empty)
        table = reduce(DataFrame.unionByName, [read_csv(spark, paths, fields) for paths in groups.values()])
        keys = ["gtfs_feed_date", key]
    return first_per_key(table, keys, ["_block", "_row"]).drop("_block", "_row")


def read_stops(spark: SparkSession, *, gtfs_dir: str | None = None, gtfs_root: str | None = None) -> DataFrame:
    stops = read_feeds(spark, gtfs_dir, gtfs_root, "stops.txt", STOP_FIELDS, "stop_id", STOP_SCHEMA)
    if "gtfs_stop_name" in stops.columns:
        return stops
    return stops.withColumnRenamed("stop_name", "gtfs_stop_name").withColumns(
        {c: F.col(c).try_cast("double") for c in ("stop_lat", "stop_lon")}
    )


def read_routes(spark: SparkSession, *, gtfs_dir: str | None = None, gtfs_root: str | None = None) -> DataFrame:
    return read_feeds(spark, gtfs_dir, gtfs_root, "routes.txt", ROUTE_FIELDS, "route_id", ROUTE_SCHEMA)


def read_city_parts(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, ("stop_id", "city_part")).select("stop_id", "city_part")
