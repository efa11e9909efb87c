"""Time expressions: parsing, local calendar, windows, labels."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone as tzinfo
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, functions as F

from punctual.schemas import DEFAULT_RUSH_WINDOWS, DEFAULT_TIMEZONE


def boundary(value: str | datetime, timezone: str = DEFAULT_TIMEZONE) -> datetime:
    """A period boundary in UTC; values without an offset are local times."""
    parsed = value if isinstance(value, datetime) else datetime.fromisoformat(value)
    if parsed.tzinfo is None:
        parsed = parsed.replace(tzinfo=ZoneInfo(timezone))
    return parsed.astimezone(tzinfo.utc)


def floor_second(value: datetime) -> datetime:
    return value.replace(microsecond=0)


def ceil_second(value: datetime) -> datetime:
    floored = floor_second(value)
    return floored if floored == value else floored + timedelta(seconds=1)


def representative_time() -> Column:
    return F.coalesce("next_aimed_arrival_time_utc", "recorded_at_utc")


def within(time: Column, start: datetime | None, end: datetime | None) -> Column:
    """start <= time < end on whole seconds: the start floored, the end ceiled."""
    condition = F.lit(True)
    if start is not None:
        condition = condition & (time >= F.lit(floor_second(start)))
    if end is not None:
        condition = condition & (time < F.lit(ceil_second(end)))
    return condition


def represented_within(start: datetime | None, end: datetime | None) -> Column:
    """`within` of the representative time, as conditions on its two columns that a scan can take over."""
    aimed, recorded = F.col("next_aimed_arrival_time_utc"), F.col("recorded_at_utc")
    return within(aimed, start, end) | (aimed.isNull() & within(recorded, start, end))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Number of second boundaries crossed from start to end."""
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    return F.unix_seconds(end) - F.unix_seconds(start)


def with_local_calendar(df: DataFrame, time: str, timezone: str = DEFAULT_TIMEZONE) -> DataFrame:
    """Add local_time, local_date, local_hour, local_weekday (Monday 0), ..."""
    local = F.col("local_time")
    minute_of_day = F.hour(local) * 60 + F.minute(local)
    return df.withColumn("local_time", F.from_utc_timestamp(F.col(time), timezone)).withColumns(
        {
            "local_date": F.to_date(local),
            "local_hour": F.hour(local),
            "local_weekday": F.weekday(local),
            "is_weekday": F.weekday(local) < 5,
            "day_type": F.when(F.weekday(local) < 5, "weekday").otherwise("weekend"),
            "local_minutes": minute_of_day,
        }
    )


def minute_of(text: str) -> int:
    hour, minute = (int(part) for part in text.strip().split(":", 1))
    if not (0 <= hour < 24 and 0 <= minute < 60):
        raise ValueError(f"not a time of day: {text!r}")
    return hour * 60 + minute


def rush_windows(values=DEFAULT_RUSH_WINDOWS) -> list[tuple[int, int]]:
    windows = []
    for value in values:
        try:
            start, end = (minute_of(part) for part in value.split("-", 1))
        except ValueError as error:
            raise ValueError(f"rush window {value!r} is not HH:MM-HH:MM") from error
        if start == end:
            raise ValueError(f"rush window {value!r} starts and ends at the same time")
        windows.append((start, end))
    return windows


def is_rush(windows=DEFAULT_RUSH_WINDOWS, include_weekends: bool = False) -> Column:
    """Start inclusive, end exclusive; a window past midnight wraps."""
    minute = F.col("local_minutes")
    parts = [
        (minute >= start) & (minute < end) if start < end else (minute >= start) | (minute < end)
        for start, end in rush_windows(windows)
    ]
    inside = reduce(lambda a, b: a | b, parts, F.lit(False))
    return inside if include_weekends else inside & F.col("is_weekday")


def hour_label(hour: str = "local_hour") -> Column:
    return F.format_string("%02d:00", F.col(hour))


def second_text(time: Column | str) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def minute_text(time: Column | str) -> Column:
    """Published times carry no seconds."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm'+00:00'")
