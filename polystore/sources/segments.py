"""Binary log segments and sorted tables, read with Spark's binary file source and written by plain functions.

A segment or table is a row of one binary file; files parse in parallel, on any store Spark reads.
A segment is read up to its first bad frame, whatever follows; a table is read up to its index.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the formats, all numbers big-endian.
FRAME, FRAME_MAGIC, FRAME_VERSION = ">4sBQdBIII", b"ZWAL", 1
FRAME_OPS = {1: "SET", 2: "DEL", 3: "EXPIRE", 4: "TXN_BEGIN", 5: "TXN_COMMIT", 6: "TXN_ROLLBACK", 7: "FLUSH"}
TABLE_HEADER, TABLE_MAGIC, TABLE_VERSION = 5, b"ZSST", 1
ENTRY, TRAILER, TRAILER_MAGIC = ">HI", ">Q8s", b"ZSSTFOOT"
DELETED = b"__TOMBSTONE__"  # the default; a store may use another
CHECKED = ">BQ"
FRAME_SIZE, ENTRY_SIZE, TRAILER_SIZE = struct.calcsize(FRAME), struct.calcsize(ENTRY), struct.calcsize(TRAILER)


def frame(lsn: int, ts: float, op: str, key: bytes, value: bytes = b"") -> bytes:
    code = next(c for c, name in FRAME_OPS.items() if name == op)
    crc = zlib.crc32(struct.pack(CHECKED, code, lsn) + key + value)
    return struct.pack(FRAME, FRAME_MAGIC, FRAME_VERSION, lsn, ts, code, len(key), len(value), crc) + key + value


def frames_of(data: bytes) -> Iterator[tuple[int, float, str, bytes, bytes]]:
    at = 0
    while at + FRAME_SIZE <= len(data):
        magic, version, lsn, ts, code, keys, values, crc = struct.unpack_from(FRAME, data, at)
        end = at + FRAME_SIZE + keys + values
        if magic != FRAME_MAGIC or version != FRAME_VERSION or code not in FRAME_OPS or end > len(data):
            return
        key, value = data[at + FRAME_SIZE : at + FRAME_SIZE + keys], data[at + FRAME_SIZE + keys : end]
        if zlib.crc32(struct.pack(CHECKED, code, lsn) + key + value) != crc:
            return
        yield lsn, ts, FRAME_OPS[code], key, value
        at = end


def entries_of(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:TABLE_HEADER] != TABLE_MAGIC + bytes([TABLE_VERSION]) or len(data) < TABLE_HEADER + TRAILER_SIZE:
        return
    footer, magic = struct.unpack_from(TRAILER, data, len(data) - TRAILER_SIZE)
    if magic != TRAILER_MAGIC:
        return
    (stop,) = struct.unpack_from(">Q", data, footer)
    at = TABLE_HEADER
    while at < stop:
        keys, values = struct.unpack_from(ENTRY, data, at)
        middle = at + ENTRY_SIZE + keys
        yield data[at + ENTRY_SIZE : middle], data[middle : middle + values]
        at = middle + values


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)


def read_log(spark: SparkSession, path: str, suffix: str = ".log") -> DataFrame:
    """(segment, lsn, ts, op, key, value) of a folder of segments."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(name, *f) for f in frames_of(bytes(content))]
                yield pd.DataFrame(rows, columns=["segment", "lsn", "ts", "op", "key", "value"])

    return _files(spark, path, suffix).select("path", "content").mapInPandas(parse, "segment string, lsn long, ts double, op string, key binary, value binary")


def read_tables(spark: SparkSession, path: str, suffix: str = ".sst", deleted: bytes = DELETED) -> DataFrame:
    """(table, key, value, deleted) of a folder of sorted tables; deleted is the value that stands for a deletion."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(name, k, None if v == deleted else v, v == deleted) for k, v in entries_of(bytes(content))]
                yield pd.DataFrame(rows, columns=["table", "key", "value", "deleted"])

    return _files(spark, path, suffix).select("path", "content").mapInPandas(parse, "table string, key binary, value binary, deleted boolean")


def log_rows(read: DataFrame) -> DataFrame:
    """Read frames as rows of the change log: (lsn, key, op, value)."""
    return read.where(F.col("op").isin("SET", "DEL")).select("lsn", F.col("key").cast("string").alias("key"), "op", F.col("value").cast("string").alias("value"))
