"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the node, both of which split hot nodes; the edges of
a step are written to the shared checkpoint folder, so lineage stays short and a lost executor
costs one step. What is few enough, by a fixed bound, is finished in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polystore.llm.common import cut, dealt_join

FEW = 200_000  # edges, some 20 MB in the task that takes them


def _links(spark_df: DataFrame, ascending: bool) -> DataFrame:
    """One star step over (a, b) with a > b: large-star if not ascending, small-star if so."""
    if ascending:
        rows = spark_df.select(F.col("a").alias("u"), F.col("b").alias("v"))
    else:
        rows = spark_df.select(F.col("a").alias("u"), F.col("b").alias("v")).union(spark_df.select(F.col("b"), F.col("a")))
    least = cut(rows.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")))  # read anew, so that AQE can split the join's hot nodes
    joined = dealt_join(rows, least, "u")
    out = joined.where(F.col("v") > F.col("u")) if not ascending else joined
    moved = out.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if ascending:
        moved = moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges of one task, by union and find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) of every node of the edges (a, b), longs; root is the least node that can be reached.

    Star steps go on until nothing changes or at most `few` edges are left, which one task finishes.
    """
    edges = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:  # the steps converge, in a logarithmic number of rounds
        new = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if new["n"] <= few:
            return cut(edges.repartition(1).mapInArrow(_forest, "node long, root long"))
        if new == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b"))).distinct()
        state = new
        edges = cut(_links(_links(edges, False), True))
