"""Event-time windows, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(rows: DataFrame, column: str = "ts", late: str | None = None) -> DataFrame:
    """rows whose time can carry a watermark."""
    rows = rows.withColumn(column, F.col(column).cast("timestamp"))
    return rows.withWatermark(column, late) if late else rows


def counted(rows: DataFrame, length: str, slide: str | None = None, by: list[str] | None = None, column: str = "ts") -> DataFrame:
    """Rows in tumbling (or, with a slide, sliding) windows."""
    window = F.window(column, length, slide) if slide else F.window(column, length)
    out = rows.groupBy(window.alias("w"), *(by or [])).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(by or []), "n")


def sessions(rows: DataFrame, gap: str, by: list[str], column: str = "ts") -> DataFrame:
    out = rows.groupBy(F.session_window(column, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
