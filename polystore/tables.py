"""The driver's tables, and the logical tables the engine derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a change log: (lsn, ts, key, op, value, k, user_id); an error deletes the key."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("lsn"),
        "ts",
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        F.when(F.col("event_type") == "error", "DEL").otherwise("SET").alias("op"),
        F.col("event_type").alias("value"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        "user_id",
    )


#: The same for DuckDB, to begin a statement with.
EVENT_LOG_SQL = """WITH log AS (
    SELECT event_id AS lsn, ts, 'user:' || user_id AS key, CASE WHEN event_type = 'error' THEN 'DEL' ELSE 'SET' END AS op,
           event_type AS value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id
    FROM events)
"""
