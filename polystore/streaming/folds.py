"""Streams: the log fold and expiring state, with the same results as their batch forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from polystore.sources.runs import scratch


def stream_of(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A folder (or file) of Parquet as a stream."""
    schema = spark.read.parquet(path).schema
    one = f"{path[:-1]}[{path[-1]}]"  # a pattern, since the source takes no single file, which nothing else matches
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(one)


def _run(out: DataFrame, mode: str, write) -> None:
    spark = out.sparkSession
    started = out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start()
    started.awaitTermination()


def fold_log(log: DataFrame) -> DataFrame:
    """Current state of a streamed log (lsn, key, op, value): updated keys are merged into a table batch by batch."""
    spark, path = log.sparkSession, scratch(log.sparkSession, "fold")
    last = log.groupBy("key").agg(F.max_by(F.struct("op", "value", "lsn"), "lsn").alias("last"))
    schema = "key string, op string, value string, lsn bigint"

    def merge(batch: DataFrame, n: int) -> None:
        batch.select("key", "last.op", "last.value", "last.lsn").write.mode("overwrite").parquet(f"{path}/batch={n}")  # again after a failure: the same rows

    _run(last, "update", merge)
    rows = spark.read.schema(schema).parquet(path)
    newest = rows.groupBy("key").agg(F.max_by(F.struct("op", "value"), "lsn").alias("last"))
    return newest.where("last.op <> 'DEL'").select("key", "last.value")


STATE = "births long, n long, expires long, lsn long"
OUT = "key string, births long, n long, lsn long"


def _live(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    births, n, expires, last = state.get if state.exists else (0, 0, -1, -1)
    rows = pd.concat(list(batches)).sort_values("lsn")
    for lsn, at, lives in zip(rows["lsn"], rows["at"], rows["lives"], strict=True):
        if n == 0 or expires <= at:
            births, n = births + 1, 0
        n, expires, last = n + 1, int(at) + int(lives), int(lsn)
    state.update((births, n, expires, last))
    yield pd.DataFrame({"key": [key[0]], "births": [births], "n": [n], "lsn": [last]})


def expiring_counts(writes: DataFrame) -> DataFrame:
    """Of streamed writes (key, lsn, at, lives; microseconds): how often each key came to life, and its writes since.

    A write finds its key dead if the last one's time to live has passed by then.
    """
    spark, path = writes.sparkSession, scratch(writes.sparkSession, "expiring")
    out = writes.groupBy("key").applyInPandasWithState(_live, OUT, STATE, "update", "NoTimeout")
    _run(out, "update", lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"))
    rows = spark.read.schema(OUT).parquet(path)
    return rows.groupBy("key").agg(F.max_by(F.struct("births", "n"), "lsn").alias("last")).select("key", "last.births", "last.n")
