"""The registry of queries: each name has a function of (spark, sf_dir) and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def load() -> None:
    """Imports the modules that register queries."""
    from polystore.plans import document_queries, keyvalue_queries, log_queries, stream_queries, text_queries, vector_queries  # noqa: F401
