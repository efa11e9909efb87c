"""DuckDB SQL for every registered query, written from the analysis rules.

Where the Spark side works on histograms (percentiles, matched contexts, alert
controls) the SQL here uses plain rows, joins and anti-joins.
"""

from __future__ import annotations

MIN = 5
LIMIT = 20
TOP, TOP_PARTS = 5, 3

# The formulas that define the metrics.
METRICS = {
    "bucket_count": "CAST(COUNT(*) AS BIGINT)",
    "raw_poll_count": "CAST(COALESCE(SUM(raw_poll_count), 0) AS BIGINT)",
    "signed_mean_delay_min": "AVG(delay_seconds) / 60.0",
    "avg_delay_min": "AVG(delay_seconds) / 60.0",
    "median_delay_min": "MEDIAN(delay_seconds) / 60.0",
    "p75_delay_min": "QUANTILE_CONT(delay_seconds, 0.75) / 60.0",
    "p90_delay_min": "QUANTILE_CONT(delay_seconds, 0.90) / 60.0",
    "p95_delay_min": "QUANTILE_CONT(delay_seconds, 0.95) / 60.0",
    "pct_late": "AVG(CASE WHEN delay_seconds > 0 THEN 1.0::DOUBLE ELSE 0.0 END) * 100.0",
    "pct_over_3_min_late": "AVG(CASE WHEN delay_seconds > 180 THEN 1.0::DOUBLE ELSE 0.0 END) * 100.0",
    "pct_over_5_min_late": "AVG(CASE WHEN delay_seconds > 300 THEN 1.0::DOUBLE ELSE 0.0 END) * 100.0",
    "pct_early": "AVG(CASE WHEN delay_seconds < 0 THEN 1.0::DOUBLE ELSE 0.0 END) * 100.0",
    "pct_over_1_min_early": "AVG(CASE WHEN delay_seconds < -60 THEN 1.0::DOUBLE ELSE 0.0 END) * 100.0",
    "pct_over_3_min_early": "AVG(CASE WHEN delay_seconds < -180 THEN 1.0::DOUBLE ELSE 0.0 END) * 100.0",
    "median_early_min_abs": "COALESCE(QUANTILE_CONT(-delay_seconds, 0.5) FILTER (WHERE delay_seconds < 0) / 60.0, 0.0)",
    "p90_early_min_abs": "COALESCE(QUANTILE_CONT(-delay_seconds, 0.9) FILTER (WHERE delay_seconds < 0) / 60.0, 0.0)",
}
COUNTS = ("bucket_count", "raw_poll_count")


def r6(expression: str) -> str:
    return f"ROUND(CAST({expression} AS DOUBLE), 6) + 0.0::DOUBLE"


def metrics(prefix: str = "") -> str:
    return ", ".join(f"{sql} AS {prefix}{name}" for name, sql in METRICS.items())


def shown(columns, prefix: str = "") -> str:
    """Counts as they are, other columns rounded."""
    return ", ".join(c if c.endswith("_count") else f"{r6(prefix + c)} AS {c}" for c in columns)


ALL_METRICS = shown(METRICS)


def first(column: str, order: str = "representative_time_utc") -> str:
    return f"FIRST({column} ORDER BY {order} NULLS LAST, {column}) FILTER (WHERE {column} IS NOT NULL)"


def local(time: str) -> str:
    return f"timezone('Europe/Helsinki', timezone('UTC', {time}))"


def text(time: str) -> str:
    return f"strftime({time}, '%Y-%m-%d %H:%M:%S.%f')"


def iso(time: str) -> str:
    return f"strftime({time}, '%Y-%m-%dT%H:%M:%SZ')"


CTES = {
    "ev": """
        SELECT event_id, user_id, event_type, value, ts AS r,
            CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
        FROM events""",
    "obs": """
        SELECT event_id AS id,
            CASE WHEN k % 17 = 5 THEN NULL WHEN k % 19 = 3 THEN -event_id - 1
                WHEN k % 4 = 0 THEN event_id - event_id % 2 ELSE event_id END AS poll_id,
            CAST(user_id AS VARCHAR) AS vehicle_id,
            CASE WHEN k % 41 <> 8 THEN r END AS recorded_at_utc,
            r + INTERVAL 90 SECOND AS valid_until_utc,
            'L' || (k % 12) AS line_ref,
            CASE WHEN k % 50 <> 0 THEN CAST(1 + k % 2 AS VARCHAR) END AS direction_ref,
            CASE WHEN k % 20 = 3 THEN r + INTERVAL 1800 SECOND ELSE r - INTERVAL 300 SECOND END AS origin_aimed,
            user_id || '|' || strftime(date_trunc('week', r), '%Y-%m-%d') AS trip_match_key,
            CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS is_gtfs_matchable,
            CASE WHEN k % 30 <> 1 THEN 'Line ' || (k % 12) END AS published_line_name,
            CAST(floor(value * 10) - 300 + CASE WHEN k = 99 THEN 9000 ELSE 0 END AS DOUBLE) AS delay_seconds,
            CASE WHEN k % 60 <> 7 THEN CAST(k % 8 AS VARCHAR) END AS next_stop_point_ref,
            CASE WHEN k % 16 <> 9 THEN 'Stop ' || (k % 8) END AS next_stop_point_name,
            CASE WHEN k % 10 <> 9 THEN r END AS aimed_arrival,
            CASE WHEN k % 10 <> 9 THEN r + to_seconds(CAST(floor(value * 10) - 300
                + CASE WHEN k = 99 THEN 9000 ELSE 0 END
                + CASE WHEN k % 15 = 4 THEN 900 ELSE 0 END AS BIGINT)) END AS expected_arrival,
            CASE WHEN k % 20 = 11 THEN r - INTERVAL 3600 SECOND ELSE r + INTERVAL 3600 SECOND END AS destination_aimed,
            r + INTERVAL 45 SECOND AS created_at_utc
        FROM ev""",
    "polls0": """
        SELECT event_id AS id, event_type AS source, r AS attempted_at_utc,
            CASE WHEN k % 10 <> 0 THEN r + CASE WHEN k % 25 = 7 THEN INTERVAL 600 SECOND
                ELSE INTERVAL 30 SECOND END END AS collected_at_utc,
            CASE WHEN k % 10 <> 0 THEN 'ok' ELSE 'error' END AS status,
            CASE WHEN k % 10 <> 0 THEN 1 ELSE 0 END AS ok,
            CASE WHEN k % 10 <> 0 THEN CAST(k AS DOUBLE) END AS row_count
        FROM ev""",
    "polls": """
        SELECT p.*, s.previous_success, CAST(date_diff('second', s.previous_success, p.collected_at_utc) AS DOUBLE) AS gap
        FROM polls0 p LEFT JOIN (
            SELECT id, LAG(collected_at_utc) OVER (PARTITION BY source ORDER BY collected_at_utc, id) AS previous_success
            FROM polls0 WHERE ok = 1
        ) s USING (id)""",
    "alert": """
        SELECT event_id, 'alert-' || event_id AS source_alert_id,
            CASE WHEN k % 2 = 0 THEN 'L' || (k % 12) END AS line_ref,
            CASE WHEN k % 11 <> 0 THEN 'C' || (k % 3) ELSE 'Unknown' END AS cause,
            'E' || (k % 2) AS effect,
            CASE WHEN k % 13 <> 0 THEN k % 4 ELSE -1 END AS priority,
            CASE WHEN k % 35 <> 10 THEN r END AS validity_start,
            CASE WHEN k % 35 <> 0 THEN r + INTERVAL 6 HOUR END AS validity_end,
            r AS created_at,
            CASE WHEN k % 25 <> 0 THEN 'R' || (k % 12) END AS route_ref,
            CAST(k % 8 AS VARCHAR) AS stop_ref
        FROM ev WHERE event_type = 'error' AND k % 45 <> 5""",
    "feeds": "SELECT DATE '2024-01-08' AS feed, '' AS suffix UNION ALL SELECT DATE '2024-01-20', ' v2'",
    "stops": """
        SELECT feed AS gtfs_feed_date, CAST(n_nationkey AS VARCHAR) AS stop_id,
            CASE WHEN n_nationkey <> 7 THEN n_name || suffix END AS gtfs_stop_name,
            CASE WHEN n_nationkey NOT IN (5, 7) THEN 60.0::DOUBLE + n_nationkey / 100.0::DOUBLE END AS stop_lat,
            CASE WHEN n_nationkey NOT IN (5, 7) THEN 22.0::DOUBLE + n_nationkey / 50.0::DOUBLE END AS stop_lon
        FROM nation, feeds""",
    "routes": """
        SELECT feed AS gtfs_feed_date, 'R' || n_nationkey AS route_id,
            'L' || CASE WHEN suffix = '' THEN n_nationkey ELSE (n_nationkey + 1) % 12 END AS route_short_name
        FROM nation, feeds""",
    "city": """
        SELECT CAST(n_nationkey AS VARCHAR) AS stop_id, CASE WHEN n_nationkey <> 6 THEN r_name END AS city_part
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "measured": """
        SELECT o.*, p.collected_at_utc,
            COALESCE(p.collected_at_utc, o.created_at_utc) AS collected
        FROM obs o LEFT JOIN polls0 p ON p.id = o.poll_id
        WHERE is_gtfs_matchable = 1 AND delay_seconds IS NOT NULL AND line_ref IS NOT NULL""",
    "flagged": """
        SELECT *,
            date_diff('second', recorded_at_utc, collected) AS observation_age_seconds,
            date_diff('second', valid_until_utc, collected) AS validity_lag_seconds,
            date_diff('second', aimed_arrival, expected_arrival) AS stop_call_delay_seconds,
            abs(date_diff('second', aimed_arrival, expected_arrival) - delay_seconds) AS stop_call_delay_diff_seconds,
            COALESCE(abs(delay_seconds) > 7200, FALSE) AS is_implausible_delay,
            COALESCE(date_diff('second', recorded_at_utc, collected) > 300, FALSE)
                OR COALESCE(valid_until_utc < collected, FALSE) AS is_stale_observation,
            COALESCE(recorded_at_utc < origin_aimed - INTERVAL 15 MINUTE, FALSE) AS is_pre_trip_observation,
            COALESCE(recorded_at_utc > destination_aimed + INTERVAL 30 MINUTE, FALSE) AS is_post_trip_observation,
            COALESCE(abs(date_diff('second', aimed_arrival, expected_arrival) - delay_seconds) > 600, FALSE)
                AS has_stop_call_disagreement
        FROM measured""",
    "q": """
        SELECT *,
            is_implausible_delay::INT + is_stale_observation::INT + is_pre_trip_observation::INT
                + is_post_trip_observation::INT + has_stop_call_disagreement::INT AS quality_issue_count,
            is_implausible_delay OR is_stale_observation OR is_pre_trip_observation OR is_post_trip_observation AS excluded
        FROM flagged""",
    "br": """
        SELECT id, trip_match_key, vehicle_id, line_ref, COALESCE(direction_ref, 'Unknown') AS direction_ref,
            next_stop_point_ref, COALESCE(published_line_name, line_ref) AS published_line_name, next_stop_point_name,
            delay_seconds, recorded_at_utc, COALESCE(aimed_arrival, recorded_at_utc) AS representative_time_utc
        FROM q WHERE NOT excluded AND COALESCE(aimed_arrival, recorded_at_utc) IS NOT NULL""",
}

TRIP_STOP = ("trip_match_key", "vehicle_id", "line_ref", "direction_ref", "next_stop_point_ref")


def calendar(source: str, time: str = "representative_time_utc") -> str:
    t = local(time)
    return f"""
        SELECT *, {t} AS local_time, CAST({t} AS DATE) AS local_date, CAST(hour({t}) AS BIGINT) AS local_hour,
            CAST(isodow({t}) - 1 AS BIGINT) AS local_weekday, isodow({t}) <= 5 AS is_weekday,
            CASE WHEN isodow({t}) <= 5 THEN 'weekday' ELSE 'weekend' END AS day_type,
            CAST(hour({t}) * 60 + minute({t}) AS BIGINT) AS local_minutes
        FROM ({source})"""


def grouped(keys, source: str = "br") -> str:
    identity = " || '|' || ".join(f"COALESCE(CAST({k} AS VARCHAR), '<NA>')" for k in keys)
    listed = ", ".join(keys)
    stop = "" if "next_stop_point_ref" in keys else "NULL::VARCHAR AS next_stop_point_ref,"
    return f"""
        SELECT {identity} AS bucket_id, {listed}, {stop}
            MEDIAN(delay_seconds) AS delay_seconds, CAST(COUNT(*) AS BIGINT) AS raw_poll_count,
            {first('published_line_name')} AS published_line_name,
            {first('next_stop_point_name')} AS next_stop_point_name,
            MIN(recorded_at_utc) AS recorded_at_utc, MAX(recorded_at_utc) AS last_recorded_at_utc,
            MIN(representative_time_utc) AS representative_time_utc
        FROM {source} GROUP BY {listed}"""


CTES["bk"] = calendar(grouped(TRIP_STOP))
CTES["bs"] = """
    SELECT b.*, b.next_stop_point_ref AS stop_id, f.feed AS gtfs_feed_date, s.gtfs_stop_name, s.stop_lat, s.stop_lon,
        COALESCE(s.gtfs_stop_name, b.next_stop_point_name) AS stop_name
    FROM bk b
    LEFT JOIN (SELECT feed, LEAD(feed) OVER (ORDER BY feed) AS following FROM feeds) f
        ON b.local_date >= f.feed AND (f.following IS NULL OR b.local_date < f.following)
    LEFT JOIN stops s ON s.gtfs_feed_date = f.feed AND s.stop_id = b.next_stop_point_ref"""

NEEDS = {
    "ev": [],
    "obs": ["ev"],
    "polls0": ["ev"],
    "polls": ["polls0"],
    "alert": ["ev"],
    "feeds": [],
    "stops": ["feeds"],
    "routes": ["feeds"],
    "city": [],
    "measured": ["obs", "polls0"],
    "flagged": ["measured"],
    "q": ["flagged"],
    "br": ["q"],
    "bk": ["br"],
    "bs": ["bk", "stops"],
}


def sql(query: str, *needs: str, **extra: str) -> str:
    """WITH the needed base tables, then the extra ones, then the query."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for parent in NEEDS[name]:
            visit(parent)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    parts = [f"{n} AS ({CTES[n]})" for n in ordered] + [f"{n} AS ({body})" for n, body in extra.items()]
    return f"WITH {', '.join(parts)} {query}"


QUALITY_FLAGS = (
    "is_implausible_delay",
    "is_stale_observation",
    "is_pre_trip_observation",
    "is_post_trip_observation",
    "has_stop_call_disagreement",
)


def quality_rows(passes: str) -> str:
    flags = ", ".join(f"{f}::INT::BIGINT AS {f}" for f in QUALITY_FLAGS)
    return f"""
        SELECT id, {text('collected_at_utc')} AS collected_at_utc, observation_age_seconds, validity_lag_seconds,
            stop_call_delay_seconds, {r6('stop_call_delay_diff_seconds')} AS stop_call_delay_diff_seconds, {flags},
            quality_issue_count::BIGINT AS quality_issue_count, ({passes})::INT::BIGINT AS quality_pass FROM q"""


def bucket_rows(mode: str, first_recorded: str = "recorded_at_utc") -> str:
    return f"""
        SELECT bucket_id, '{mode}' AS bucket_mode, line_ref, direction_ref, published_line_name,
            {r6('delay_seconds')} AS delay_seconds, {r6('delay_seconds / 60.0')} AS delay_min, raw_poll_count,
            next_stop_point_ref, next_stop_point_name, {text('representative_time_utc')} AS representative_time_utc,
            {text('recorded_at_utc')} AS recorded_at_utc, {text(first_recorded)} AS first_recorded_at_utc,
            {text('last_recorded_at_utc')} AS last_recorded_at_utc, {text('local_time')} AS local_time,
            CAST(local_date AS VARCHAR) AS local_date, local_hour, local_weekday,
            is_weekday::INT::BIGINT AS is_weekday, day_type, local_minutes"""


LATE = (
    "bucket_count", "raw_poll_count", "signed_mean_delay_min", "median_delay_min", "p75_delay_min", "p90_delay_min",
    "p95_delay_min", "pct_over_3_min_late", "pct_over_5_min_late",
)
EARLY = (
    "bucket_count", "raw_poll_count", "signed_mean_delay_min", "median_delay_min", "pct_early",
    "pct_over_1_min_early", "pct_over_3_min_early", "median_early_min_abs", "p90_early_min_abs",
)
LATE_ORDER = "p90_delay_min DESC, pct_over_5_min_late DESC, bucket_count DESC"
EARLY_ORDER = "p90_early_min_abs DESC, pct_over_3_min_early DESC, bucket_count DESC"
ROBUST_ORDER = "p90_delay_min DESC, pct_over_5_min_late DESC, bucket_count"
NAME = f"{first('published_line_name')} AS line_name"
HOUR = "LPAD(CAST(local_hour AS VARCHAR), 2, '0') || ':00' AS hour_local"


def by(keys: str, minimum: int = MIN, name: bool = True, source: str = "bk", extra: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys} " if keys else ""
    return (
        f"SELECT {lead}{NAME + ', ' if name else ''}{extra}{metrics()} FROM {source} {group}"
        f"HAVING COUNT(*) >= {minimum}"
    )


def ranked(inner: str, lead: str, columns, order: str, limit: int | None = LIMIT, position: bool = False) -> str:
    tail = f"LIMIT {limit}" if limit else ""
    inner = f"SELECT *, ROW_NUMBER() OVER (ORDER BY {order}) AS position FROM ({inner}) ORDER BY {order} {tail}"
    return f"SELECT {lead}, {shown(columns)}{', position' if position else ''} FROM ({inner})"


LINES = by("line_ref")
CONTEXT = "line_ref, direction_ref, local_hour, day_type"


def rush(condition: str) -> str:
    pairs = ("bucket_count", "raw_poll_count", "median_delay_min", "p90_delay_min", "pct_over_5_min_late")
    listed = []
    for c in pairs:
        for side in ("non_rush", "rush"):
            listed.append(f"{side}.{c} AS {c}_{side}" if c in COUNTS else f"{r6(f'{side}.{c}')} AS {c}_{side}")
    lifts = {
        "rush_median_delay_lift_min": "median_delay_min",
        "rush_p90_delay_lift_min": "p90_delay_min",
        "rush_over_5_min_late_pct_point_lift": "pct_over_5_min_late",
    }
    for alias, c in lifts.items():
        listed.append(f"{r6(f'rush.{c} - non_rush.{c}')} AS {alias}")
    return sql(
        f"""SELECT rush.line_ref, COALESCE(rush.line_name, non_rush.line_name) AS line_name, {', '.join(listed)},
            ROW_NUMBER() OVER (ORDER BY rush.p90_delay_min - non_rush.p90_delay_min DESC,
            rush.pct_over_5_min_late - non_rush.pct_over_5_min_late DESC, rush.bucket_count DESC, rush.line_ref) AS position
        FROM (SELECT * FROM grouped WHERE is_rush) rush JOIN (SELECT * FROM grouped WHERE NOT is_rush) non_rush USING (line_ref)
        ORDER BY position LIMIT {TOP}""",
        "bk",
        marked=f"SELECT *, {condition} AS is_rush FROM bk",
        grouped=by("line_ref, is_rush", source="marked"),
    )


STOP_KEYS = "stop_id, stop_name, stop_lat, stop_lon"
STOP_METRICS = by(STOP_KEYS, name=False, source="bs", extra="COUNT(DISTINCT line_ref) AS line_count, ")
STOP_LEAD = f"stop_id, stop_name, {r6('stop_lat')} AS stop_lat, {r6('stop_lon')} AS stop_lon, line_count"

SUMMARY = ("bucket_count", "raw_poll_count", "median_delay_min", "p90_delay_min", "pct_over_5_min_late")


def summary(source: str) -> str:
    return f"""
        SELECT {shown(SUMMARY)}, line_count, stop_count FROM (
            SELECT {metrics()}, COUNT(DISTINCT line_ref) AS line_count,
                COUNT(DISTINCT next_stop_point_ref) AS stop_count FROM {source})"""


COMPARED = (
    "bucket_count", "raw_poll_count", "median_delay_min", "p90_delay_min", "pct_over_5_min_late", "pct_over_3_min_early",
)
CHANGES = {
    "median_delay_min": "median_delay_change_min",
    "p90_delay_min": "p90_delay_change_min",
    "pct_over_5_min_late": "over_5_min_late_pct_point_change",
}


def period_change(key: str, names, order: str, preferred: str, other: str, limit: int = TOP) -> dict[str, str]:
    """CTEs from period_rows (with `period`) to `result`."""
    context = f"{key}, line_ref, direction_ref, local_weekday, local_hour"
    listed = ", ".join(f"{first(n)} AS {n}" for n in names)
    listed = listed + ", " if listed else ""
    columns = [f"b.{key}"] + [f"COALESCE({preferred}.{n}, {other}.{n}) AS {n}" for n in names]
    for c in COMPARED:
        for side, period in (("b", "baseline"), ("c", "comparison")):
            columns.append(f"{side}.{c} AS {period}_{c}" if c in COUNTS else f"{r6(f'{side}.{c}')} AS {period}_{c}")
        if c in CHANGES:
            columns.append(f"{r6(f'c.{c} - b.{c}')} AS {CHANGES[c]}")
    return {
        "matched_contexts": f"""
            SELECT DISTINCT {context} FROM period_rows WHERE period = 'baseline'
            INTERSECT SELECT DISTINCT {context} FROM period_rows WHERE period = 'comparison'""",
        "matched": f"SELECT p.* FROM period_rows p SEMI JOIN matched_contexts m USING ({context}) WHERE period IS NOT NULL",
        "sides": f"SELECT {key}, period, {listed}{metrics()} FROM matched GROUP BY {key}, period HAVING COUNT(*) >= {MIN}",
        "result": f"""
            SELECT {', '.join(columns)}, ROW_NUMBER() OVER (ORDER BY {order}, c.bucket_count DESC, b.{key}) AS position
            FROM (SELECT * FROM sides WHERE period = 'baseline') b
            JOIN (SELECT * FROM sides WHERE period = 'comparison') c ON b.{key} = c.{key}
            ORDER BY position LIMIT {limit}""",
    }


MIDPOINT = {
    "bounds": """
        SELECT MIN(epoch_ms(representative_time_utc)) AS start_ms, MAX(epoch_ms(representative_time_utc)) AS end_ms
        FROM bk WHERE next_stop_point_ref IS NOT NULL""",
    "halves": "SELECT start_ms, start_ms + (end_ms - start_ms) // 2 AS middle_ms, end_ms FROM bounds",
    "period_rows": """
        SELECT bk.*, next_stop_point_ref AS stop_id, next_stop_point_name AS stop_name,
            CASE WHEN epoch_ms(representative_time_utc) < middle_ms THEN 'baseline' ELSE 'comparison' END AS period
        FROM bk, halves WHERE next_stop_point_ref IS NOT NULL AND start_ms < end_ms""",
}


def windowed(start: str, end: str, extra: str = "", name: str = "wk") -> dict[str, str]:
    """Buckets of the polls in [start, end)."""
    selected = f"""(SELECT * FROM br WHERE representative_time_utc >= {start} AND representative_time_utc < {end} {extra})"""
    return {name: calendar(grouped(TRIP_STOP, selected))}


def at_helsinki_midnight(day: str) -> str:
    return f"timezone('UTC', timezone('Europe/Helsinki', TIMESTAMP '{day}'))"


def change_query(bounds, key: str, names, order: str, window, limit: int = TOP, **before: str) -> str:
    baseline_start, baseline_end, comparison_start, comparison_end = bounds
    enriched = CTES["bs"].replace("FROM bk b", "FROM wk b")
    where = "WHERE city_part IS NOT NULL" if key == "city_part" else ""
    return sql(
        "SELECT * FROM result",
        "br",
        "stops",
        "city",
        **before,
        **windowed(*window, "AND next_stop_point_ref IS NOT NULL"),
        ws=enriched,
        period_rows=f"""
            SELECT ws.*, city_part, CASE
                WHEN representative_time_utc >= {comparison_start} AND representative_time_utc < {comparison_end} THEN 'comparison'
                WHEN representative_time_utc >= {baseline_start} AND representative_time_utc < {baseline_end} THEN 'baseline'
                END AS period
            FROM ws LEFT JOIN city USING (stop_id) {where}""",
        **period_change(key, names, order, "b", "c", limit),
    )


EXPLICIT = tuple(at_helsinki_midnight(d) for d in ("2024-01-02", "2024-01-12", "2024-01-12", "2024-01-22"))
STOP_NAMES = ("stop_name", "city_part", "stop_lat", "stop_lon")
LATEST = """
    SELECT date_trunc('second', MAX(COALESCE(aimed_arrival, recorded_at_utc)) + INTERVAL 999999 MICROSECOND)
        + INTERVAL 1 SECOND AS newest FROM obs
    WHERE is_gtfs_matchable = 1 AND delay_seconds IS NOT NULL AND line_ref IS NOT NULL"""
RECENT = tuple(
    f"(SELECT newest - INTERVAL {d} DAY FROM latest)" for d in (14, 7, 7, 0)
)


def alert_ctes(source: str, alerts: str = "SELECT * FROM alert", scopes: str = "TRUE") -> dict[str, str]:
    return {
        "chosen": alerts,
        "span": f"SELECT MIN(representative_time_utc) AS lo, MAX(representative_time_utc) AS hi FROM {source}",
        "timed": """
            SELECT cause, effect, CAST(priority AS BIGINT) AS priority, line_ref, route_ref, stop_ref,
                COALESCE(validity_start, created_at, lo) AS start_utc,
                COALESCE(validity_end, hi + INTERVAL 1 MICROSECOND) AS end_utc
            FROM chosen, span""",
        "named": f"""
            SELECT t.*, COALESCE(
                (SELECT route_short_name FROM routes r WHERE r.route_id = t.route_ref AND r.gtfs_feed_date = (
                    SELECT MAX(feed) FROM feeds WHERE feed <= CAST({local('t.start_utc')} AS DATE))),
                t.route_ref) AS route_name
            FROM timed t""",
        "targets": f"""
            SELECT * FROM (
                SELECT DISTINCT cause, effect, priority, 'route' AS alert_scope, line_ref AS target_ref, start_utc, end_utc
                FROM named WHERE line_ref IS NOT NULL
                UNION
                SELECT DISTINCT cause, effect, priority, 'route', route_name, start_utc, end_utc
                FROM named WHERE route_name IS NOT NULL
                UNION
                SELECT DISTINCT cause, effect, priority, 'stop', stop_ref, start_utc, end_utc FROM named
            ) WHERE {scopes}""",
    }


GROUP = ("cause", "effect", "priority", "alert_scope")


def lift_ctes(source: str, by_line: bool, minimum: int) -> dict[str, str]:
    group = ", ".join(GROUP)
    keys = group + (", line_ref" if by_line else "")
    name = f"{NAME}, " if by_line else ""
    columns = [f"a.{k}" for k in keys.split(", ")] + (["a.line_name"] if by_line else [])
    lifts = {
        "median_delay_min": "median_delay_lift_min",
        "p90_delay_min": "p90_delay_lift_min",
        "pct_over_5_min_late": "over_5_min_late_pct_point_lift",
    }
    for c in COMPARED:
        for side, label in (("c", "control"), ("a", "alert")):
            columns.append(f"{side}.{c} AS {c}_{label}" if c in COUNTS else f"{r6(f'{side}.{c}')} AS {c}_{label}")
        if c in lifts:
            columns.append(f"{r6(f'a.{c} - c.{c}')} AS {lifts[c]}")
    return {
        "active_ids": f"""
            SELECT DISTINCT {', '.join('t.' + g for g in GROUP)}, b.bucket_id
            FROM targets t JOIN {source} b ON b.line_ref = t.target_ref AND t.alert_scope = 'route'
                AND b.representative_time_utc >= t.start_utc AND b.representative_time_utc <= t.end_utc
            UNION
            SELECT DISTINCT {', '.join('t.' + g for g in GROUP)}, b.bucket_id
            FROM targets t JOIN {source} b ON b.next_stop_point_ref = t.target_ref AND t.alert_scope = 'stop'
                AND b.representative_time_utc >= t.start_utc AND b.representative_time_utc <= t.end_utc""",
        "active": f"SELECT {group}, b.* FROM active_ids JOIN {source} b USING (bucket_id)",
        "contexts": f"SELECT DISTINCT {group}, {CONTEXT} FROM active",
        "controls": f"""
            SELECT {', '.join('c.' + g for g in GROUP)}, b.*
            FROM contexts c JOIN {source} b USING ({CONTEXT})
            ANTI JOIN active_ids i ON i.bucket_id = b.bucket_id AND i.cause = c.cause AND i.effect = c.effect
                AND i.priority = c.priority AND i.alert_scope = c.alert_scope""",
        "am": f"SELECT {keys}, {name}{metrics()} FROM active GROUP BY {keys} HAVING COUNT(*) >= {minimum}",
        "cm": f"SELECT {keys}, {metrics()} FROM controls GROUP BY {keys} HAVING COUNT(*) >= {minimum}",
        "result": f"""
            SELECT {', '.join(columns)}
            FROM am a JOIN cm c ON {' AND '.join(f'a.{k} = c.{k}' for k in keys.split(', '))}
            ORDER BY a.p90_delay_min - c.p90_delay_min DESC, a.pct_over_5_min_late - c.pct_over_5_min_late DESC,
                a.bucket_count DESC, {', '.join('a.' + k for k in keys.split(', '))}
            LIMIT {LIMIT}""",
    }


PROFILE = """
    SELECT source, CAST(COUNT(*) AS BIGINT) AS poll_count, CAST(SUM(ok) AS BIGINT) AS success_count,
        CAST(SUM(1 - ok) AS BIGINT) AS failed_count,
        MEDIAN(gap) FILTER (WHERE ok = 1 AND gap > 0) AS cadence, AVG(row_count) FILTER (WHERE ok = 1) AS avg_rows
    FROM polls GROUP BY source"""


def gaps(multiplier: str = "2", minimum_minutes: str = "0") -> str:
    return f"""
        SELECT p.source, p.previous_success AS gap_start, p.collected_at_utc AS gap_end, p.gap AS gap_seconds,
            p.status AS next_success_status, cadence, avg_rows, GREATEST(0.0::DOUBLE, p.gap - cadence) AS missing,
            (SELECT COUNT(*) FROM polls f WHERE f.source = p.source AND f.ok = 0
                AND f.attempted_at_utc > p.previous_success AND f.attempted_at_utc < p.collected_at_utc) AS failed_attempt_count
        FROM polls p JOIN profile USING (source)
        WHERE p.ok = 1 AND p.gap > {multiplier} * cadence AND GREATEST(0.0::DOUBLE, p.gap - cadence) >= {minimum_minutes} * 60"""


def spots(start: str, end: str, limit: str) -> str:
    return f"""
        SELECT source, {start} AS gap_start_utc, {end} AS gap_end_utc, {r6('gap_seconds / 60.0')} AS gap_min,
            {r6('cadence')} AS expected_cadence_seconds, {r6('missing / 60.0')} AS missing_min,
            {r6('missing / cadence')} AS estimated_missed_polls,
            {r6('missing / cadence * avg_rows')} AS estimated_missed_rows, failed_attempt_count, next_success_status
        FROM gaps ORDER BY missing DESC, source, gap_start {limit}"""


PUBLIC_CONTEXTS = by("line_ref, direction_ref, day_type, local_hour")
STOP_METRIC_COLUMNS = (
    "bucket_count", "raw_poll_count", "signed_mean_delay_min", "median_delay_min", "p90_delay_min",
    "pct_over_5_min_late", "pct_over_3_min_early", "p90_early_min_abs",
)


def stop_variant(keys: str, line: str, day: str) -> str:
    return f"""
        SELECT stop_id, {line} AS line_ref, {day} AS day_type, {', '.join(METRICS)} FROM (
            SELECT {keys}, {metrics()} FROM (SELECT *, next_stop_point_ref AS stop_id FROM bk WHERE next_stop_point_ref IS NOT NULL)
            GROUP BY {keys} HAVING COUNT(*) >= {MIN})"""


PUBLIC_STOPS = " UNION ALL ".join(
    [
        stop_variant("stop_id", "'all'", "'all'"),
        stop_variant("stop_id, day_type", "'all'", "day_type"),
        stop_variant("stop_id, line_ref", "line_ref", "'all'"),
        stop_variant("stop_id, line_ref, day_type", "line_ref", "day_type"),
    ]
)
CANONICAL = """
    SELECT o.stop_id, COALESCE(n.gtfs_stop_name, o.fallback, o.stop_id) AS stop_name, n.stop_lat, n.stop_lon, o.line_count
    FROM (
        SELECT next_stop_point_ref AS stop_id, COUNT(DISTINCT line_ref) AS line_count,
            LAST(next_stop_point_name ORDER BY representative_time_utc, next_stop_point_name)
                FILTER (WHERE next_stop_point_name IS NOT NULL) AS fallback
        FROM bk WHERE next_stop_point_ref IS NOT NULL GROUP BY 1
    ) o LEFT JOIN (SELECT * FROM stops WHERE gtfs_feed_date = DATE '2024-01-20') n USING (stop_id)"""
NATURAL = "CAST(regexp_extract(line_ref, '(\\d+)', 1) AS INTEGER)"


def quality_summary() -> str:
    checks = {"analysis_rows": "TRUE", **{f: f for f in QUALITY_FLAGS}}
    checks["conservative_excluded_default"] = "excluded"
    checks["conservative_excluded_with_stop_call_disagreement"] = "excluded OR has_stop_call_disagreement"
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS quality_check, CAST(COUNT(*) FILTER (WHERE {c}) AS BIGINT) AS row_count,
        {r6(f'COUNT(*) FILTER (WHERE {c}) / COUNT(*)::DOUBLE * 100.0')} AS pct_rows FROM q"""
        for name, c in checks.items()
    )


def grid() -> str:
    hours = ", ".join(
        f"{r6(f'MAX(p90_delay_min) FILTER (WHERE local_hour = {h})')} AS h{h:02d}" for h in range(24)
    )
    return f"""SELECT line_ref, {r6('AVG(p90_delay_min)')} AS sort_metric, CAST(SUM(bucket_count) AS BIGINT) AS total_buckets,
        {hours} FROM hourly GROUP BY line_ref"""


PREPARED = f"""
    SELECT {STOP_KEYS.replace('stop_lat, stop_lon', '')} {r6('stop_lat')} AS stop_lat, {r6('stop_lon')} AS stop_lon,
        CAST(gtfs_feed_date AS VARCHAR) AS gtfs_feed_date, gtfs_stop_name,
        (gtfs_stop_name IS NOT NULL)::INT::BIGINT AS has_gtfs_stop_metadata, local_minutes AS local_minute_of_day,
        {bucket_rows('trip-stop').strip()[len('SELECT '):]}
    FROM bs WHERE recorded_at_utc IS NOT NULL"""


def watermark(times: str, source: str, sliced_by: str, sliced: str) -> str:
    """Where a stream of 20 slices ends: its latest time, in milliseconds, less three slices."""
    width = f"(SELECT (epoch_us(MAX({sliced_by})) - epoch_us(MIN({sliced_by}))) // 20 + 1 FROM {sliced})"
    return f"""
        SELECT date_trunc('milliseconds', MAX({times})) - to_seconds(3 * {width} // 1000000 + 1) AS mark FROM {source}"""


def two_digits(column: str) -> str:
    """Half away from zero on eight decimal digits, so that the last bit of a sum decides no tie."""
    return f"CAST(ROUND(ROUND(CAST(CAST({column} AS VARCHAR) AS DECIMAL(38, 18)), 8), 2) AS DOUBLE) + 0.0::DOUBLE"


FEEDS_READ_BACK = f"""
    SELECT 'feed' AS kind, CAST(feed AS VARCHAR) AS gtfs_feed_date, 'gtfs_' || feed AS ref, NULL::VARCHAR AS name,
        NULL::DOUBLE AS lat, NULL::DOUBLE AS lon FROM feeds
    UNION ALL SELECT 'latest', NULL, stop_id, gtfs_stop_name, {r6('stop_lat')}, {r6('stop_lon')} FROM stops
        WHERE gtfs_feed_date = (SELECT MAX(feed) FROM feeds)
    UNION ALL SELECT 'stop', CAST(gtfs_feed_date AS VARCHAR), stop_id, gtfs_stop_name, {r6('stop_lat')}, {r6('stop_lon')} FROM stops
    UNION ALL SELECT 'route', CAST(gtfs_feed_date AS VARCHAR), route_id, route_short_name, NULL, NULL FROM routes
    UNION ALL SELECT 'part', NULL, stop_id, city_part, NULL, NULL FROM city"""


STREAM_POLLS = f"""
    SELECT id, source, {text('attempted_at_utc')} AS attempted_at_utc, {text('collected_at_utc')} AS collected_at_utc,
        status, ok::BIGINT AS ok, {r6('row_count')} AS row_count FROM polls0"""

SILENCES = """
    SELECT source, gap_start, LEAD(gap_start) OVER (PARTITION BY source ORDER BY gap_start) AS gap_end,
        LEAD(status) OVER (PARTITION BY source ORDER BY gap_start) AS next_success_status
    FROM (SELECT source, collected_at_utc AS gap_start, MIN(status) AS status FROM polls0 WHERE ok = 1 GROUP BY ALL)"""
# A silence counts from its 601st second on; it ends, or is noticed, before the stream's last watermark.
ALARMS = f"""
    SELECT source, 'closed' AS state, {text('gap_start')} AS gap_start_utc, {text('gap_end')} AS gap_end_utc,
        date_diff('second', gap_start, gap_end) AS gap_seconds,
        (SELECT COUNT(*) FROM polls0 f WHERE f.source = s.source AND f.ok = 0
            AND f.attempted_at_utc > gap_start AND f.attempted_at_utc < gap_end) AS failed_attempt_count, next_success_status
    FROM silences s, final WHERE date_diff('second', gap_start, gap_end) > 600 AND gap_end < mark
    UNION ALL
    SELECT source, 'open', {text('gap_start')}, NULL, NULL, NULL, NULL FROM silences, final
    WHERE gap_start < mark AND ((date_diff('second', gap_start, gap_end) > 600 AND gap_end < mark)
        OR ((gap_end IS NULL OR date_diff('second', gap_start, gap_end) > 600)
            AND date_trunc('second', gap_start) + INTERVAL 601 SECOND <= mark))"""


def all_oracles() -> dict[str, str]:
    analysis = "is_gtfs_matchable = 1 AND delay_seconds IS NOT NULL AND line_ref IS NOT NULL"
    ws, we = "TIMESTAMP '2024-01-10 04:00:00'", "TIMESTAMP '2024-01-24 16:00:00'"
    line_window = "AND line_ref = 'L4' AND next_stop_point_ref IS NOT NULL"
    mid_order = "ABS(c.p90_delay_min - b.p90_delay_min) DESC"
    recent_lo, recent_hi = "(SELECT newest - INTERVAL 2 DAY FROM latest)", "(SELECT newest FROM latest)"
    own_flags = CTES["flagged"]
    # The thresholds of the catalogue's query in place of the defaults.
    for default, own in (
        ("abs(delay_seconds) > 7200", "abs(delay_seconds) > 600"),
        ("collected) > 300", "collected) > 40"),
        ("INTERVAL 15 MINUTE", "INTERVAL 60 SECOND"),
        ("INTERVAL 30 MINUTE", "INTERVAL 120 SECOND"),
        ("- delay_seconds) > 600", "- delay_seconds) > 30"),
    ):
        assert default in own_flags, default
        own_flags = own_flags.replace(default, own)
    oracles = {
        "source_profile": sql(
            f"""SELECT COUNT(*)::BIGINT AS vehicle_observation_count, MAX(id) AS vehicle_observation_max_id,
            {text('MIN(recorded_at_utc)')} AS vehicle_observation_start_utc, {text('MAX(recorded_at_utc)')} AS vehicle_observation_end_utc,
            COUNT(*) FILTER (WHERE {analysis}) AS analysis_row_count, MAX(id) FILTER (WHERE {analysis}) AS analysis_row_max_id,
            {text(f'MIN(recorded_at_utc) FILTER (WHERE {analysis})')} AS analysis_start_utc,
            {text(f'MAX(recorded_at_utc) FILTER (WHERE {analysis})')} AS analysis_end_utc,
            (SELECT COUNT(*) FROM ev) AS collector_poll_count,
            (SELECT COUNT(*) FROM ev WHERE event_type = 'error') AS service_alert_count FROM obs""",
            "obs",
        ),
        "quality_rows": sql(quality_rows("NOT excluded"), "q"),
        "quality_rows_colocated": sql(quality_rows("NOT excluded"), "q"),
        "line_metrics_raw": sql(
            f"SELECT line_ref, line_name, {ALL_METRICS} FROM ({by('line_ref', source='raw')})", "q",
            raw=CTES["br"].replace("NOT excluded AND ", "").replace("SELECT id,", "SELECT id, 1::BIGINT AS raw_poll_count,"),
        ),
        "quality_rows_strict": sql(quality_rows("quality_issue_count = 0"), "q"),
        "quality_rows_without_polls": sql(quality_rows("NOT excluded"), "q").replace(
            "FROM obs o LEFT JOIN polls0 p ON p.id = o.poll_id", "FROM obs o LEFT JOIN polls0 p ON FALSE"
        ),
        "quality_summary": sql(quality_summary(), "q"),
        "quality_by_line": sql(
            f"""SELECT *, ROW_NUMBER() OVER (ORDER BY conservative_excluded_pct DESC, conservative_excluded_rows DESC, line_ref)
            AS position FROM (SELECT line_ref, {first('published_line_name', 'recorded_at_utc')} AS line_name, COUNT(*)::BIGINT AS row_count,
            COUNT(*) FILTER (WHERE is_implausible_delay) AS implausible_delay_rows,
            COUNT(*) FILTER (WHERE is_stale_observation) AS stale_rows,
            COUNT(*) FILTER (WHERE is_pre_trip_observation) AS pre_trip_rows,
            COUNT(*) FILTER (WHERE is_post_trip_observation) AS post_trip_rows,
            COUNT(*) FILTER (WHERE has_stop_call_disagreement) AS stop_call_disagreement_rows,
            COUNT(*) FILTER (WHERE excluded) AS conservative_excluded_rows,
            {r6('COUNT(*) FILTER (WHERE excluded) / COUNT(*)::DOUBLE * 100.0')} AS conservative_excluded_pct
            FROM q GROUP BY line_ref HAVING COUNT(*) >= {MIN}) ORDER BY position LIMIT {TOP}""",
            "q",
        ),
        "quality_rows_diagnostic": sql(quality_rows("TRUE"), "q"),
        "quality_rows_raw": sql(quality_rows("TRUE"), "q"),
        "quality_rows_thresholds": sql(
            quality_rows("NOT excluded").replace("FROM q", "FROM own_q"),
            "measured",
            own_flags=own_flags,
            own_q=CTES["q"].replace("FROM flagged", "FROM own_flags"),
        ),
        "quality_examples": sql(
            f"""SELECT id, {text('recorded_at_utc')} AS recorded_at_utc, line_ref, direction_ref, vehicle_id, trip_match_key,
            next_stop_point_ref, {r6('delay_seconds / 60.0')} AS delay_min, observation_age_seconds,
            {r6('stop_call_delay_diff_seconds')} AS stop_call_delay_diff_seconds,
            {', '.join(f'{f}::INT::BIGINT AS {f}' for f in QUALITY_FLAGS)}
            FROM q WHERE quality_issue_count > 0
            ORDER BY quality_issue_count DESC, q.recorded_at_utc NULLS LAST, id LIMIT {LIMIT}""",
            "q",
        ),
        "buckets_trip_stop": sql(bucket_rows("trip-stop") + " FROM bk", "bk"),
        "buckets_vehicle_trip": sql(
            bucket_rows("vehicle-trip") + " FROM vk", "br", vk=calendar(grouped(TRIP_STOP[:4]))
        ),
        "buckets_line_hour": sql(
            bucket_rows("line-hour") + " FROM hk",
            "br",
            lr=calendar("SELECT * FROM br"),
            hk=calendar(
                "SELECT * EXCLUDE (local_date, local_hour, day_type) FROM ("
                + grouped(("line_ref", "direction_ref", "local_date", "local_hour", "day_type"), "lr")
                + ")"
            ),
        ),
        "buckets_poll": sql(
            bucket_rows("poll") + " FROM pk",
            "br",
            pk=calendar(
                "SELECT *, CAST(id AS VARCHAR) AS bucket_id, 1::BIGINT AS raw_poll_count,"
                " recorded_at_utc AS last_recorded_at_utc FROM br"
            ),
        ),
        "buckets_windowed": sql(bucket_rows("trip-stop") + " FROM wk", "br", **windowed(ws, we, line_window)),
        "bucket_summary": sql(
            f"""SELECT COUNT(*)::BIGINT AS bucket_count, SUM(raw_poll_count)::BIGINT AS raw_poll_count,
            COUNT(DISTINCT line_ref) AS line_count, {iso('MIN(representative_time_utc)')} AS observation_start_utc,
            {iso('MAX(representative_time_utc)')} AS observation_end_utc,
            CAST(MIN(local_date) AS VARCHAR) AS local_start_date, CAST(MAX(local_date) AS VARCHAR) AS local_end_date FROM bk""",
            "bk",
        ),
        "line_robust": sql(ranked(LINES, "line_ref, line_name", METRICS, ROBUST_ORDER + ", line_ref", TOP, True), "bk"),
        "line_late": sql(ranked(LINES, "line_ref, line_name", LATE, LATE_ORDER + ", line_ref", TOP, True), "bk"),
        "line_early": sql(ranked(LINES, "line_ref, line_name", EARLY, EARLY_ORDER + ", line_ref", TOP, True), "bk"),
        "line_rankings": sql(
            "SELECT 'late' AS ranking, * FROM ("
            + ranked(LINES, "line_ref, line_name", LATE, LATE_ORDER + ", line_ref", TOP)
            + ") UNION ALL BY NAME SELECT 'early' AS ranking, * FROM ("
            + ranked(LINES, "line_ref, line_name", EARLY, EARLY_ORDER + ", line_ref", TOP)
            + ")",
            "bk",
        ),
        "context_metrics": sql(
            ranked(by(CONTEXT), f"line_ref, line_name, direction_ref, {HOUR}, day_type", METRICS, f"{ROBUST_ORDER}, {CONTEXT}"),
            "bk",
        ),
        "context_metrics_filtered": sql(
            ranked(
                by(CONTEXT, source="(SELECT * FROM bk WHERE line_ref = 'L4' AND direction_ref = '1' AND day_type = 'weekday')"),
                f"line_ref, line_name, direction_ref, {HOUR}, day_type", METRICS, f"{ROBUST_ORDER}, {CONTEXT}",
            ),
            "bk",
        ),
        "hourly_profile": sql(ranked(by("local_hour", name=False), HOUR, METRICS, "local_hour", None), "bk"),
        "hourly_profile_line": sql(
            ranked(
                by("local_hour", 1, False, "(SELECT * FROM bk WHERE line_ref = 'L4')"), HOUR, METRICS,
                ROBUST_ORDER + ", local_hour", 10,
            ),
            "bk",
        ),
        "rush_impact": rush(
            "((local_minutes >= 420 AND local_minutes < 540) OR (local_minutes >= 900 AND local_minutes < 1080)) AND is_weekday"
        ),
        "rush_impact_overnight": rush("(local_minutes >= 1320 OR local_minutes < 120)"),
        "line_hour_metrics": sql(
            f"SELECT line_ref, local_hour, line_name, {ALL_METRICS} FROM ({by('line_ref, local_hour')})", "bk"
        ),
        "line_hour_grid": sql(grid(), "bk", hourly=by("line_ref, local_hour")),
        "prepared_observations": sql(PREPARED, "bs"),
        "stop_metrics": sql(f"SELECT {STOP_LEAD}, {ALL_METRICS} FROM ({STOP_METRICS})", "bs"),
        "late_stops": sql(ranked(STOP_METRICS, STOP_LEAD, METRICS, f"{LATE_ORDER}, {STOP_KEYS}", 5), "bs"),
        "early_stops": sql(ranked(STOP_METRICS, STOP_LEAD, METRICS, f"{EARLY_ORDER}, {STOP_KEYS}", 5), "bs"),
        "stop_heat": sql(
            f"""SELECT stop_id, stop_name, {r6('stop_lat')} AS stop_lat, {r6('stop_lon')} AS stop_lon, bucket_count,
            {r6('pct_over_3_min_early / 100.0 * bucket_count')} AS heat_weight FROM ({STOP_METRICS})
            WHERE stop_lat IS NOT NULL AND stop_lon IS NOT NULL AND pct_over_3_min_early > 0""",
            "bs",
        ),
        "stop_heat_scaled": sql(
            f"""SELECT stop_id, stop_name, {r6('heat_weight')} AS heat_weight, {r6('shaped')} AS shaped_weight,
            {r6('(SELECT QUANTILE_CONT(shaped, 0.99) FROM heat)')} AS intensity_max,
            {r6('(SELECT QUANTILE_CONT(shaped, 0.5) FROM heat)')} AS intensity_cutoff FROM heat""",
            "bs",
            heat=f"""SELECT *, GREATEST(p90_delay_min, 0) * bucket_count AS heat_weight,
                sqrt(GREATEST(p90_delay_min, 0) * bucket_count) AS shaped FROM ({STOP_METRICS})
                WHERE stop_lat IS NOT NULL AND stop_lon IS NOT NULL AND p90_delay_min > 0""",
        ),
        "stop_heat_shapes": sql(
            " UNION ALL ".join(
                f"""SELECT '{name}' AS response, stop_id, {r6(shape)} AS shaped_weight, {r6(cap)} AS intensity_max,
                NULL::DOUBLE AS intensity_cutoff FROM heat"""
                for name, shape, cap in (
                    ("linear", "heat_weight", "(SELECT QUANTILE_CONT(heat_weight, 0.99) FROM heat)"),
                    ("log1p", "ln(1 + heat_weight)", "(SELECT MAX(ln(1 + heat_weight)) FROM heat)"),
                    ("manual", "heat_weight", "25.0"),
                )
            ),
            "bs",
            heat=f"""SELECT stop_id, GREATEST(p90_delay_min, 0) * bucket_count AS heat_weight FROM ({STOP_METRICS})
                WHERE stop_lat IS NOT NULL AND stop_lon IS NOT NULL AND p90_delay_min > 0""",
        ),
        "stop_markers": sql(
            f"""SELECT stop_id, stop_name, bucket_count,
            {r6('''CASE WHEN (SELECT MIN(root) = MAX(root) FROM sm) THEN 19.5 ELSE 9.0 + (root - (SELECT MIN(root) FROM sm))
                / ((SELECT MAX(root) FROM sm) - (SELECT MIN(root) FROM sm)) * 21.0 END''')} AS marker_size,
            {r6('(SELECT QUANTILE_CONT(ABS(median_delay_min), 0.95) FROM sm WHERE ABS(median_delay_min) > 0)')} AS colour_extent
            FROM sm""",
            "bs",
            sm=f"SELECT *, sqrt(bucket_count::DOUBLE) AS root FROM ({STOP_METRICS})",
        ),
        "selection_summary": sql(summary("bk"), "bk"),
        "filter_options": sql(
            f"""SELECT CAST(MIN(local_date) AS VARCHAR) AS min_date, CAST(MAX(local_date) AS VARCHAR) AS max_date,
            (SELECT string_agg(line_ref, ',' ORDER BY {NATURAL}) FROM (SELECT DISTINCT line_ref FROM bk)) AS line_options,
            (SELECT string_agg(direction_ref, ',' ORDER BY direction_ref) FROM (SELECT DISTINCT direction_ref FROM bk))
                AS direction_options FROM bk""",
            "bk",
        ),
        "filtered_summary": sql(
            summary(
                """(SELECT * FROM bk WHERE local_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'
                AND line_ref IN ('L1', 'L4', 'L6') AND direction_ref IN ('1', '2') AND is_weekday
                AND local_minutes BETWEEN 390 AND 1095)"""
            ),
            "bk",
        ),
        "midpoint_summary": sql(
            f"""SELECT {iso('make_timestamp_ms(start_ms)')} AS baseline_start_utc, {iso('make_timestamp_ms(middle_ms)')} AS baseline_end_utc,
            {iso('make_timestamp_ms(middle_ms)')} AS comparison_start_utc, {iso('make_timestamp_ms(end_ms)')} AS comparison_end_utc
            FROM halves WHERE start_ms < end_ms""",
            "bk",
            bounds=MIDPOINT["bounds"],
            halves=MIDPOINT["halves"],
        ),
        "stop_change_midpoint": sql(
            "SELECT * FROM result", "bk", **MIDPOINT, **period_change("stop_id", ("stop_name",), mid_order, "c", "b")
        ),
        "stop_change_explicit": change_query(
            EXPLICIT, "stop_id", STOP_NAMES, "c.p90_delay_min - b.p90_delay_min DESC", (EXPLICIT[0], EXPLICIT[3])
        ),
        "stop_change_recent": change_query(
            RECENT, "stop_id", STOP_NAMES, "c.p90_delay_min - b.p90_delay_min", (RECENT[0], RECENT[3]),
            latest=LATEST + " AND next_stop_point_ref IS NOT NULL",
        ),
        "city_part_change": change_query(
            EXPLICIT, "city_part", ("stop_name", "stop_lat", "stop_lon"), mid_order, (EXPLICIT[0], EXPLICIT[3]), TOP_PARTS
        ),
        "alert_targets": sql(
            f"""SELECT cause, effect, priority, alert_scope, target_ref, {text('start_utc')} AS start_utc,
            {text('end_utc')} AS end_utc FROM targets""",
            "bk", "alert", "routes",
            **alert_ctes("bk"),
        ),
        "alert_grouped": sql(
            "SELECT * FROM result", "bk", "alert", "routes", **alert_ctes("bk"), **lift_ctes("bk", False, MIN)
        ),
        "alert_stops": sql(
            "SELECT * FROM result", "bk", "alert", "routes",
            **alert_ctes("bk", scopes="alert_scope = 'stop'"), **lift_ctes("bk", False, MIN),
        ),
        "alert_by_line": sql(
            "SELECT * FROM result", "bk", "alert", "routes", **alert_ctes("bk"), **lift_ctes("bk", True, MIN)
        ),
        "alert_recent_routes": sql(
            "SELECT * FROM result", "br", "alert", "routes",
            latest=LATEST,
            **windowed(recent_lo, recent_hi),
            **alert_ctes(
                "wk",
                f"""SELECT * FROM alert WHERE COALESCE(validity_start, created_at) < {recent_hi}
                    AND (validity_end IS NULL OR validity_end >= {recent_lo})""",
                "alert_scope = 'route'",
            ),
            **lift_ctes("wk", False, 1),
        ),
        "collector_blackouts": sql(
            f"""SELECT source, poll_count, success_count, failed_count, {r6('cadence')} AS expected_cadence_seconds,
            COUNT(gap)::BIGINT AS blackout_count, {r6('COALESCE(SUM(missing), 0) / 60.0')} AS total_blackout_min,
            {r6('COALESCE(MAX(missing), 0) / 60.0')} AS largest_blackout_min,
            {r6('COALESCE(SUM(missing / cadence), 0)')} AS estimated_missed_polls,
            {r6('COALESCE(SUM(missing / cadence * avg_rows), 0)')} AS estimated_missed_rows
            FROM profile LEFT JOIN (
                SELECT source, gap, GREATEST(0.0::DOUBLE, gap - cadence) AS missing FROM polls JOIN profile USING (source)
                WHERE ok = 1 AND gap > 0 AND gap > 2 * cadence
            ) USING (source) GROUP BY source, poll_count, success_count, failed_count, cadence, avg_rows
            ORDER BY total_blackout_min DESC, blackout_count DESC, source LIMIT {LIMIT}""",
            "polls",
            profile=PROFILE,
        ),
        "collector_gaps": sql(
            f"""SELECT source, {text('gap_start')} AS gap_start_utc, {text('gap_end')} AS gap_end_utc,
            {r6('gap_seconds')} AS gap_seconds, next_success_status, {r6('cadence')} AS expected_cadence_seconds,
            {r6('avg_rows')} AS avg_rows_per_success, {r6('missing')} AS missing_seconds, failed_attempt_count FROM gaps""",
            "polls",
            profile=PROFILE,
            gaps=gaps(),
        ),
        "collector_missing_spots": sql(
            spots(iso("gap_start"), iso("gap_end"), f"LIMIT {LIMIT}"), "polls", profile=PROFILE, gaps=gaps()
        ),
        "collector_long_spots": sql(
            spots(iso("gap_start"), iso("gap_end"), ""), "polls", profile=PROFILE, gaps=gaps("3", "2") + " AND source = 'view'"
        ),
        "collector_missing_summary": sql(
            f"""SELECT source, poll_count, success_count, failed_count, COUNT(missing)::BIGINT AS missing_spot_count,
            {r6('COALESCE(SUM(missing), 0) / 60.0')} AS total_missing_min, {r6('COALESCE(MAX(missing), 0) / 60.0')} AS largest_missing_min,
            {r6('COALESCE(SUM(missing / g.cadence), 0)')} AS estimated_missed_polls,
            {r6('COALESCE(SUM(missing / g.cadence * g.avg_rows), 0)')} AS estimated_missed_rows
            FROM profile LEFT JOIN gaps g USING (source) GROUP BY source, poll_count, success_count, failed_count""",
            "polls",
            profile=PROFILE,
            gaps=gaps(),
        ),
        "stops_asof": sql(
            f"""SELECT bucket_id, stop_id, CAST(gtfs_feed_date AS VARCHAR) AS gtfs_feed_date, stop_name,
            {r6('stop_lat')} AS stop_lat, {r6('stop_lon')} AS stop_lon,
            (gtfs_stop_name IS NOT NULL)::INT::BIGINT AS has_gtfs_stop_metadata FROM bs""",
            "bs",
        ),
        "stop_coverage": sql(
            """SELECT COUNT(*)::BIGINT AS bucket_count,
            COUNT(*) FILTER (WHERE gtfs_stop_name IS NULL) AS unmatched_gtfs_count FROM bs""",
            "bs",
        ),
        "routes_asof": sql(
            f"""SELECT source_alert_id, {text('start_utc')} AS start_utc, route_ref,
            COALESCE(route_short_name, route_ref) AS target_ref
            FROM (SELECT *, COALESCE(validity_start, created_at) AS start_utc FROM alert WHERE route_ref IS NOT NULL) a
            LEFT JOIN (SELECT feed, LEAD(feed) OVER (ORDER BY feed) AS following FROM feeds) f
                ON CAST({local('start_utc')} AS DATE) >= feed AND (following IS NULL OR CAST({local('start_utc')} AS DATE) < following)
            LEFT JOIN routes ON route_id = route_ref AND gtfs_feed_date = feed""",
            "alert", "routes",
        ),
        "canonical_stops": sql(
            f"SELECT stop_id, stop_name, {r6('stop_lat')} AS stop_lat, {r6('stop_lon')} AS stop_lon, line_count FROM ({CANONICAL})",
            "bk", "stops",
        ),
        "results_read_back": sql(ranked(LINES, "line_ref, line_name", LATE, LATE_ORDER + ", line_ref", TOP), "bk"),
        "csv_round_trip": sql(
            "SELECT 'late' AS view, * FROM ("
            + ranked(LINES, "line_ref, line_name", LATE, LATE_ORDER + ", line_ref", TOP)
            + ") UNION ALL BY NAME SELECT 'early' AS view, * FROM ("
            + ranked(LINES, "line_ref, line_name", EARLY, EARLY_ORDER + ", line_ref", TOP)
            + ")",
            "bk",
        ),
        "stream_polls_once": sql(STREAM_POLLS, "polls0"),
        "stream_quality_rows": sql(quality_rows("NOT excluded"), "q"),
        "stream_line_hours": sql(
            f"SELECT line_ref, local_hour, line_name, {ALL_METRICS} FROM ({by('line_ref, local_hour', source='closed')})",
            "br",
            final=watermark("representative_time_utc", "br", "created_at_utc", "obs"),
            closed=calendar(
                "SELECT br.*, 1 AS raw_poll_count FROM br, final"
                " WHERE date_trunc('hour', representative_time_utc) + INTERVAL 1 HOUR <= mark"
            ),
        ),
        "stream_cadence_alarms": sql(
            ALARMS,
            "polls0",
            final=watermark("COALESCE(collected_at_utc, attempted_at_utc)", "polls0", "attempted_at_utc", "polls0"),
            silences=SILENCES,
        ),
        "json_round_trip": sql(
            f"SELECT line_ref, line_name, {', '.join(c if c in COUNTS else f'{two_digits(c)} AS {c}' for c in METRICS)},"
            f" 1::BIGINT AS schema_version FROM ({LINES})",
            "bk",
        ),
        "line_documents": sql(
            f"""SELECT line_ref, line_p90_delay_min, direction_ref, day_type, local_hour,
            CASE WHEN local_hour IS NOT NULL THEN
                ROW_NUMBER() OVER (PARTITION BY line_ref ORDER BY direction_ref, day_type, local_hour) - 1 END AS position,
            {', '.join(c if c in COUNTS else f'{two_digits(c)} AS {c}' for c in METRICS)}
            FROM ({PUBLIC_CONTEXTS}) RIGHT JOIN (SELECT line_ref, {two_digits('p90_delay_min')} AS line_p90_delay_min FROM ({LINES}))
            USING (line_ref)""",
            "bk",
        ),
        "publication_checks": sql(
            f"""SELECT section || ', ' || fault AS "check", COUNT(*)::BIGINT AS row_count,
            {', '.join(f"COUNT(*) FILTER (WHERE few AND fault = '{fault}')::BIGINT AS {column}" for fault, column in (
                ('version', 'other_version_rows'), ('number', 'non_finite_rows'), ('path', 'local_path_rows')))}
            FROM (SELECT 'lines' AS section, bucket_count % 2 = 0 AS few FROM ({LINES})
                UNION ALL SELECT 'contexts', bucket_count % 2 = 0 FROM ({PUBLIC_CONTEXTS})),
                (SELECT UNNEST(['none', 'version', 'number', 'path']) AS fault) GROUP BY section, fault""",
            "bk",
        ),
        "feeds_read_back": sql(FEEDS_READ_BACK, "stops", "routes", "city"),
        "stops_asof_files": sql(
            f"""SELECT bucket_id, stop_id, CAST(gtfs_feed_date AS VARCHAR) AS gtfs_feed_date, stop_name,
            {r6('stop_lat')} AS stop_lat, {r6('stop_lon')} AS stop_lon,
            (gtfs_stop_name IS NOT NULL)::INT::BIGINT AS has_gtfs_stop_metadata FROM bs""",
            "bs",
        ),
        "public_lines": sql(f"SELECT line_ref, line_name, {ALL_METRICS} FROM ({LINES})", "bk"),
        "public_contexts": sql(
            f"SELECT line_ref, direction_ref, day_type, local_hour, line_name, {ALL_METRICS} FROM ({PUBLIC_CONTEXTS})", "bk"
        ),
        "public_stops_grouping_sets": sql(
            f"SELECT stop_id, line_ref, day_type, {shown(STOP_METRIC_COLUMNS)} FROM ({PUBLIC_STOPS})", "bk"
        ),
        "public_gaps": sql(
            spots(*(f"strftime({t}, '%Y-%m-%dT%H:%M+00:00')" for t in ("gap_start", "gap_end")), f"LIMIT {LIMIT}"),
            "polls",
            profile=PROFILE,
            gaps=gaps(),
        ),
        "overview": sql(
            f"""SELECT {ALL_METRICS}, line_count, stop_count, CAST(start_date AS VARCHAR) AS start_date,
            CAST(end_date AS VARCHAR) AS end_date FROM (
                SELECT {metrics()}, COUNT(DISTINCT line_ref) AS line_count, COUNT(DISTINCT next_stop_point_ref) AS stop_count,
                    MIN(local_date) AS start_date, MAX(local_date) AS end_date FROM bk HAVING COUNT(*) >= {MIN})""",
            "bk",
        ),
        "default_line": sql(
            f"""SELECT line_ref, COUNT(DISTINCT local_hour)::BIGINT AS hours, SUM(bucket_count)::BIGINT AS buckets
            FROM ({PUBLIC_CONTEXTS}) WHERE direction_ref = '1' AND day_type = 'weekday' GROUP BY line_ref
            ORDER BY hours DESC, buckets DESC, {NATURAL} LIMIT 1""",
            "bk",
        ),
        "explorable_lines": sql(
            f"""SELECT line_ref, line_name, bucket_count, {r6('p90_delay_min')} AS p90_delay_min FROM ({LINES})
            WHERE line_ref IN (SELECT line_ref FROM ({PUBLIC_CONTEXTS}))""",
            "bk",
        ),
        "line_contexts": sql(
            f"""SELECT line_ref, direction_ref, day_type, local_hour, line_name, {ALL_METRICS}
            FROM ({by('line_ref, direction_ref, day_type, local_hour', 1)})
            WHERE line_ref = 'L4' AND direction_ref = '1' AND day_type = 'weekday' AND local_hour BETWEEN 6 AND 18""",
            "bk",
        ),
        "stop_search": sql(
            f"""SELECT m.stop_id, m.line_ref, m.day_type, {shown(STOP_METRIC_COLUMNS)}, stop_name, {r6('stop_lat')} AS stop_lat,
            {r6('stop_lon')} AS stop_lon, line_count, {r6('p90_early_min_abs')} AS display_value
            FROM ({PUBLIC_STOPS}) m JOIN ({CANONICAL}) c ON c.stop_id = m.stop_id
            WHERE line_ref = 'all' AND day_type = 'weekday'
                AND (lower(m.stop_id) LIKE '%nation%' OR lower(stop_name) LIKE '%nation%')""",
            "bk", "stops",
        ),
    }
    rush_sql = oracles["rush_impact"]
    oracles["takeaways"] = f"""
        SELECT id, subject, value FROM (
            (SELECT 'late-lines' AS id, line_name AS subject, p90_delay_min AS value FROM ({oracles['line_late']}) LIMIT 1)
            UNION ALL
            (SELECT 'early-lines', line_name, pct_over_3_min_early FROM ({oracles['line_early']}) LIMIT 1)
            UNION ALL
            (SELECT 'peak-hour', hour_local, p90_delay_min FROM ({oracles['hourly_profile']})
                ORDER BY p90_delay_min DESC, pct_over_5_min_late DESC, hour_local LIMIT 1)
            UNION ALL
            (SELECT 'rush-effect', line_name, rush_p90_delay_lift_min FROM ({rush_sql})
                ORDER BY rush_p90_delay_lift_min DESC, rush_over_5_min_late_pct_point_lift DESC, bucket_count_rush DESC LIMIT 1))"""
    return oracles
