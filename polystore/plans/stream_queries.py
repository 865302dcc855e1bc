"""Streaming queries over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from polystore.plans.catalog import query
from polystore.plans.keyvalue_queries import STATE
from polystore.streaming import folds, windows
from polystore.tables import EVENT_LOG_SQL as LOG
from polystore.tables import table


@query(STATE + "SELECT key, value FROM state")
def stream_log_fold(spark, d):
    events = folds.stream_of(spark, f"{d}/events.parquet")
    return folds.fold_log(events.select(F.col("event_id").alias("lsn"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.when(F.col("event_type") == "error", "DEL").otherwise("SET").alias("op"), F.col("event_type").alias("value")))


@query(
    LOG
    + """, steps AS (SELECT key, lsn, CASE WHEN lag(ts) OVER w IS NULL OR lag(ts) OVER w + to_hours(CAST(lag(k) OVER w AS INTEGER)) <= ts THEN 1 ELSE 0 END AS born
        FROM log WINDOW w AS (PARTITION BY key ORDER BY lsn)),
    lives AS (SELECT key, lsn, sum(born) OVER (PARTITION BY key ORDER BY lsn) AS births FROM steps)
    SELECT key, CAST(max(births) AS BIGINT) AS births, count(*) FILTER (births = last) AS n FROM (SELECT *, max(births) OVER (PARTITION BY key) AS last FROM lives) GROUP BY key"""
)
def stream_ttl_state(spark, d):
    events = folds.stream_of(spark, f"{d}/events.parquet")
    hours = F.get_json_object("props", "$.k").cast("bigint")
    return folds.expiring_counts(
        events.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("lsn"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (hours * 3_600_000_000).alias("lives"))
    )


def _plain(rows):
    return rows.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOURS AS \"end\", event_type, count(*) AS n FROM events GROUP BY ALL")
def x_tumbling(spark, d):
    return _plain(windows.counted(windows.timed(table(spark, d, "events")), "6 hours", by=["event_type"]))


@query(
    """SELECT b - o AS start, b - o + INTERVAL 2 HOURS AS "end", count(*) AS n FROM
    (SELECT time_bucket(INTERVAL 1 HOURS, ts, TIMESTAMP '1970-01-01') AS b, ts FROM events), (VALUES (INTERVAL 0 HOURS), (INTERVAL 1 HOURS)) AS v(o) GROUP BY ALL"""
)
def x_sliding(spark, d):
    return _plain(windows.counted(windows.timed(table(spark, d, "events")), "2 hours", "1 hour"))


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 4 HOURS AS "end", count(*) AS n FROM s GROUP BY user_id, g"""
)
def x_session(spark, d):
    return _plain(windows.sessions(windows.timed(table(spark, d, "events")), "4 hours", ["user_id"]))
