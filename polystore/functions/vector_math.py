"""Vector arithmetic in doubles over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, y: s + y)


def dot(a: Column, b: Column) -> Column:
    """Over the length of the shorter one."""
    return _total(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0 if either is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_total(F.zip_with(a, b, lambda x, y: F.coalesce((x - y) * (x - y), F.lit(0.0)))))


METRICS = {"cosine": (cosine, True), "dot": (dot, True), "euclidean": (euclidean, False)}
