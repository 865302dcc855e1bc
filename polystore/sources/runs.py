"""Sorted runs: key-ordered Parquet files whose statistics prune reads by key."""

from __future__ import annotations

import atexit
import posixpath
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or local where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="polystore-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return posixpath.join(root, f"{name}-{uuid.uuid4().hex}")


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_run(rows: DataFrame, key: str, path: str, files: int | None = None) -> None:
    """Ranges of keys, each sorted: readers skip files and row groups by their least and greatest key; a Bloom filter serves point reads."""
    dealt = rows.repartitionByRange(files, key) if files else rows.repartitionByRange(key)
    (
        dealt.sortWithinPartitions(key)
        .write.mode("errorifexists")
        .option("parquet.bloom.filter.enabled#" + key, "true")
        .parquet(path)
    )


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def get(run: DataFrame, key: str, value) -> DataFrame:
    return run.where(F.col(key) == value)


def between(run: DataFrame, key: str, start, end) -> DataFrame:
    return run.where(F.col(key).between(start, end))
