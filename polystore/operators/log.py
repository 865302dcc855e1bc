"""Folding a change log (lsn, key, op, value) into current state; reads, runs and compaction.

Latest-wins folds aggregate before they shuffle, so a hot key costs one row a task. Keys are
columns, so no key can be taken for the prefix of another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELETE = "DEL"


def latest(log: DataFrame, by: list[str], columns: list[str], order: str = "lsn") -> DataFrame:
    """The columns of the last row of each key."""
    last = log.groupBy(*by).agg(F.max_by(F.struct(*columns), order).alias("_last"))
    return last.select(*by, *[F.col(f"_last.{c}").alias(c) for c in columns])


def current(log: DataFrame, by: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """What the log leaves: the newest row of each key, deletions hidden."""
    by, columns = by or ["key"], columns or ["value"]
    return latest(log, by, [*columns, "op"]).where(F.col("op") != DELETE).drop("op")


def get(state: DataFrame, key: str) -> DataFrame:
    return state.where(F.col("key") == key)


def scan(state: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Keys from start to end, both inclusive; None is open."""
    if start is not None:
        state = state.where(F.col("key") >= start)
    if end is not None:
        state = state.where(F.col("key") <= end)
    return state


def prefix(state: DataFrame, start: str) -> DataFrame:
    return state.where(F.col("key").startswith(start))


def append(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Puts and deletions are rows of the log."""
    return log.unionByName(rows, allowMissingColumns=True)


def compact(snapshot: DataFrame, deltas: DataFrame, since: int) -> DataFrame:
    """A snapshot as of LSN since, and later rows of the log, as one snapshot; columns key, value, lsn."""
    later = deltas.where(F.col("lsn") > since).select("key", "value", "lsn", "op")
    return current(snapshot.select("key", "value", "lsn", F.lit("SET").alias("op")).unionByName(later), columns=["value", "lsn"])


def committed(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rows outside transactions, and those of transactions with a COMMIT row in outcomes (txn_id, outcome)."""
    good = outcomes.where(F.col("outcome") == "COMMIT").select("txn_id").distinct()
    return log.where("txn_id IS NULL").unionByName(log.where("txn_id IS NOT NULL").join(good, "txn_id", "left_semi").select(log.columns))


def overlay(base: DataFrame, buffered: DataFrame) -> DataFrame:
    """What a transaction reads: its own buffered writes (key, op, value), else the base (key, value)."""
    own = buffered.select("key", F.col("op").alias("_op"), F.col("value").alias("_value"))
    both = base.join(own, "key", "full_outer")
    return both.where(F.coalesce(F.col("_op"), F.lit("SET")) != DELETE).select("key", F.when(F.col("_op").isNotNull(), F.col("_value")).otherwise(F.col("value")).alias("value"))


def checksum(*columns: str) -> Column:
    """Of the columns' values, each framed by its length: no value passes for two, nor a null for an empty one."""
    parts = []
    for c in columns:
        value = F.col(c).cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.crc32(F.concat(*parts).cast("binary"))


def frames(log: DataFrame, per_segment: int) -> DataFrame:
    """Log rows as checked frames in segments."""
    return log.withColumn("segment", F.floor(F.col("lsn") / per_segment).cast("bigint")).withColumn("crc", checksum("op", "lsn", "key", "value"))


def valid_prefix(rows: DataFrame) -> DataFrame:
    """Frames before the first bad one of their segment."""
    bad = rows.where(F.col("crc") != checksum("op", "lsn", "key", "value")).groupBy("segment").agg(F.min("lsn").alias("_bad"))
    return rows.join(bad, "segment", "left").where(F.col("_bad").isNull() | (F.col("lsn") < F.col("_bad"))).drop("_bad")


def purge(rows: DataFrame, before: int) -> DataFrame:
    """Drops segments before the given one, never the last."""
    last = rows.agg(F.max("segment")).first()[0]
    return rows.where(F.col("segment") >= min(before, last if last is not None else before))
