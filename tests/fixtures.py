"""Small hand-made inputs with known results."""

from __future__ import annotations

from datetime import timedelta

from punctual.plans.tables import Tables
from punctual.schemas import ALERT_SCHEMA, OBSERVATION_SCHEMA, POLL_SCHEMA
from tests.conftest import utc


def quality_sample(spark):
    """Six rows, one per flag and a clean one."""
    rows = [
        (1, "08:00:00", "08:01:00", "08:00:30", "07:50:00", 60.0, "08:06:00"),
        (2, "08:00:00", "08:01:00", "08:00:30", "07:50:00", 8000.0, "08:06:00"),
        (3, "08:00:00", "08:01:00", "08:10:30", "07:50:00", 30.0, "08:05:30"),
        (4, "07:30:00", "08:01:00", "07:30:30", "08:00:00", 20.0, "08:05:20"),
        (5, "11:00:00", "11:01:00", "11:00:30", "07:50:00", 40.0, "08:05:40"),
        (6, "08:00:00", "08:01:00", "08:00:30", "07:50:00", 60.0, "08:20:00"),
    ]

    def at(text):
        return f"2026-04-23T{text}Z"

    columns = (
        "id long, recorded_at_utc string, valid_until_utc string, collected_at_utc timestamp, created_at_utc string,"
        " origin_aimed_departure_time_utc string, delay_seconds string, next_aimed_arrival_time_utc string,"
        " next_expected_arrival_time_utc string, destination_aimed_arrival_time_utc string, vehicle_id string,"
        " line_ref string, direction_ref string, trip_match_key string, next_stop_point_ref string,"
        " next_stop_point_name string, published_line_name string"
    )
    data = [
        (
            id, at(rec), at(valid), utc(f"2026-04-23T{col}"), at(col), at(origin), str(delay), at("08:05:00"),
            at(expected), at("09:00:00"), "v1", "3", "1", "3|1|a", "10", "Market", "3",
        )
        for id, rec, valid, col, origin, delay, expected in rows
    ]
    return spark.createDataFrame(data, columns)


def observation(id, recorded, delay, *, poll=None, vehicle="v1", trip="t", stop="10", name="Market", line="3",
                direction="1", aimed="recorded"):
    at = utc(recorded) if recorded else None
    base = at or utc(aimed)
    arrival = at if aimed == "recorded" else utc(aimed)
    return (
        id, poll, vehicle, at, base + timedelta(seconds=90), line, direction, base - timedelta(seconds=300), trip, 1,
        line, float(delay), stop, name, arrival, arrival + timedelta(seconds=delay), None, None,
        base + timedelta(seconds=3600), base + timedelta(seconds=30),
    )


def observations(spark, rows):
    return spark.createDataFrame(rows, OBSERVATION_SCHEMA)


def report_tables(spark) -> Tables:
    """Two stops in two periods, one implausible row, one blackout, one alert."""
    polls = [
        (1, "siri_vm", utc("2026-04-23T08:00:00"), utc("2026-04-23T08:00:30"), "ok", 1, 2.0, None),
        (2, "siri_vm", utc("2026-04-23T08:00:30"), utc("2026-04-23T08:01:00"), "ok", 1, 2.0, 30.0),
        (3, "siri_vm", utc("2026-04-30T08:00:00"), utc("2026-04-30T08:00:30"), "ok", 1, 1.0, 604770.0),
        (4, "siri_vm", utc("2026-04-30T08:10:00"), utc("2026-04-30T08:10:30"), "ok", 1, 1.0, 600.0),
    ]
    rows = [
        observation(1, "2026-04-23T08:00:00", 60, poll=1, trip="trip-baseline"),
        observation(2, "2026-04-23T08:00:30", 180, poll=2, trip="trip-baseline"),
        observation(3, "2026-04-30T08:00:00", 600, poll=3, vehicle="v2", trip="trip-comparison"),
        observation(4, "2026-04-30T08:10:00", -240, poll=4, vehicle="v3", trip="trip-early", stop="20",
                    name="Harbor", line="4", direction="2"),
        observation(5, "2026-04-30T08:15:00", 8000, poll=4, vehicle="v4", trip="trip-implausible", stop="30",
                    name="Airport"),
    ]
    alert = [
        ("alert-1", "3", "construction", "delay", 1, 1, utc("2026-04-30T07:00:00"), utc("2026-04-30T09:00:00"),
         "[]", "[]", utc("2026-04-30T07:00:00"))
    ]
    return Tables(
        observations=observations(spark, rows),
        polls=spark.createDataFrame(polls, POLL_SCHEMA),
        alerts=spark.createDataFrame(alert, ALERT_SCHEMA),
    )
