"""Nearest neighbours, exact and by inverted lists.

Vectors are rows (vec_id, embedding, and metadata columns).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polystore.functions.vector_math import METRICS, doubles


def insert(vectors: DataFrame, more: DataFrame, dimension: int) -> DataFrame:
    """Upsert by vec_id; a vector of another dimension fails the job; missing metadata keeps the old."""
    checked = more.withColumn("embedding", F.when(F.assert_true(F.size("embedding") == dimension).isNull(), F.col("embedding")))
    meta = [c for c in vectors.columns if c not in ("vec_id", "embedding")]
    new = checked.select("vec_id", F.col("embedding").alias("_v"), *[F.col(c).alias(f"_{c}") for c in meta])
    both = vectors.join(new, "vec_id", "full_outer")
    return both.select("vec_id", F.coalesce("_v", "embedding").alias("embedding"), *[F.coalesce(f"_{c}", c).alias(c) for c in meta])


def _filtered(vectors: DataFrame, where: dict[str, Any] | None) -> DataFrame:
    for name, value in (where or {}).items():
        vectors = vectors.where(F.col(name).eqNullSafe(F.lit(value)))
    return vectors


def _metric(name: str):
    if name not in METRICS:
        raise ValueError(f"unknown metric {name}")
    return METRICS[name]


def nearest(vectors: DataFrame, query: list[float], top: int = 10, metric: str = "cosine", where: dict[str, Any] | None = None) -> DataFrame:
    """(pos, vec_id, score): metadata first, then scores, then the best, ties by vec_id."""
    of, high = _metric(metric)
    dimension = len(query)
    v = doubles("embedding")
    v = F.when(F.assert_true(F.size("embedding") == dimension).isNull(), v)
    scored = _filtered(vectors, where).select("vec_id", of(v, F.array(*[F.lit(float(x)) for x in query])).alias("_score"))
    order = [F.desc("_score") if high else F.asc("_score"), F.asc("vec_id")]
    best = scored.orderBy(*order).limit(top)
    return best.select(F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("pos"), "vec_id", F.round("_score", 6).alias("score"))


BLOCK = 4096  # queries in a block
PART = 2048  # vectors that meet a block at once, at most
CELLS = 1 << 21  # scores that a task computes at once, 16 MB


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the queries, BLOCK at a time; the driver holds no more."""
    ids: list[int] = []
    rows: list[list[float]] = []
    for r in queries.select("query_id", "embedding").toLocalIterator():
        ids.append(r[0])
        rows.append(list(r[1]))
        if len(ids) == BLOCK:
            yield np.array(ids, dtype=np.int64), np.array(rows, dtype=np.float64)
            ids, rows = [], []
    if ids:
        yield np.array(ids, dtype=np.int64), np.array(rows, dtype=np.float64)


def _best_of(parts: list[DataFrame], spark, metric: str, top: int) -> DataFrame:
    """The best of each query of what the tasks kept."""
    found = spark.createDataFrame([], FOUND)
    for more in parts:
        found = found.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score") if METRICS[metric][1] else F.asc("score"), "vec_id")
    return found.withColumn("pos", F.row_number().over(order).cast("bigint")).where(F.col("pos") <= top).select("query_id", "pos", "vec_id", "score")


def nearest_many(queries: DataFrame, vectors: DataFrame, top: int = 10, metric: str = "cosine") -> DataFrame:
    """(query_id, pos, vec_id, score) for all queries (query_id, embedding).

    Queries come in blocks; a block is broadcast, each part of the vectors meets it as one matrix
    product, and a task keeps the best `top` of each query: queries * top rows a task are shuffled.
    """
    _metric(metric)
    return _best_of([_block(ids, q, vectors, top, metric) for ids, q in _blocks(queries)], vectors.sparkSession, metric, top)


FOUND = "query_id bigint, vec_id bigint, score double"


class Best:
    """The best `top` (score, vec_id) of each of n queries so far; ties by the lower vec_id."""

    def __init__(self, n: int, top: int, metric: str):
        self.top, self.sign = top, 1.0 if metric == "euclidean" else -1.0
        self.bar = np.full(n, np.inf)  # what the last of a full list costs
        self.query, self.name, self.cost = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)

    def take(self, queries: np.ndarray, names: np.ndarray, scores: np.ndarray) -> None:
        """scores of the vectors (columns) for some of the queries (rows)."""
        cost = self.sign * scores
        if cost.shape[1] > self.top:  # what can't be among a row's best is left out at once
            cut = np.partition(cost, self.top - 1, axis=1)[:, self.top - 1]
            q, v = np.nonzero(cost <= np.minimum(cut, self.bar[queries])[:, None])
        else:
            q, v = np.nonzero(cost <= self.bar[queries][:, None])
        if not len(q):
            return
        query, name, cost = (np.concatenate(x) for x in ((self.query, queries[q]), (self.name, names[v]), (self.cost, cost[q, v])))
        order = np.lexsort((name, cost, query))
        query, name, cost = query[order], name[order], cost[order]
        begin = np.searchsorted(query, query, side="left")
        rank = np.arange(len(query)) - begin
        last = rank == self.top - 1
        self.bar[query[last]] = cost[last]
        stay = rank < self.top
        self.query, self.name, self.cost = query[stay], name[stay], cost[stay]

    def rows(self, ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids[self.query]), pa.array(self.name), pa.array(self.sign * self.cost)], names=["query_id", "vec_id", "score"])


def _scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    if metric == "dot":
        return q @ v.T
    if metric == "cosine":
        size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
        none = size == 0
        size[none] = 1
        out = q @ v.T
        out /= size
        out[none] = 0.0
        return out
    return np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * q @ v.T))


def _part(queries: int) -> int:
    """How many vectors meet so many queries at once."""
    return max(1, min(PART, CELLS // max(1, queries)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)


def _block(ids: np.ndarray, q: np.ndarray, vectors: DataFrame, top: int, metric: str) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q))  # at most BLOCK queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best, every, step = Best(len(ids), top, metric), np.arange(len(ids)), _part(len(ids))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                best.take(every, part.column(0).to_numpy(), np.round(_scores(q, _matrix(part.column(1)), metric), 6))
        yield best.rows(ids)

    return vectors.select("vec_id", "embedding").mapInArrow(run, FOUND)


# inverted lists


def _nearest_list(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of the centroid of the greatest cosine, by vector; the lowest on ties."""
    return np.round(_scores(v, centroids, "cosine"), 12).argmax(axis=1)


def _assigned(vectors: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """vectors with cid, the centroid of the greatest cosine; the lowest cid on ties."""
    shared = vectors.sparkSession.sparkContext.broadcast(np.array(centroids, dtype=np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cid = _nearest_list(_matrix(batch.column(1)), shared.value).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cid)], names=["vec_id", "embedding", "cid"])

    return vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(run, "vec_id bigint, embedding array<float>, cid int")


def _means(vectors: DataFrame, centroids: np.ndarray) -> dict[int, list[float]]:
    """The mean of the vectors of each list that has any; a task keeps one sum a list, and they are added before they are collected."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(shared.value), dtype=np.int64), np.zeros(shared.value.shape)
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                v = _matrix(batch.column(0).slice(at, PART))
                cid = _nearest_list(v, shared.value)
                for c in np.unique(cid):
                    own = v[cid == c]
                    n[c] += len(own)
                    total[c] += own.sum(axis=0)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(n[there]), pa.array(total[there].tolist(), pa.list_(pa.float64()))], names=["cid", "n", "total"])

    sums = vectors.select("embedding").mapInArrow(run, "cid int, n bigint, total array<double>")
    sums = sums.select("cid", "n", F.posexplode("total").alias("at", "x")).groupBy("cid", "at").agg((F.sum("x") / F.sum("n")).alias("x"))
    rows = sums.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("mean")).collect()  # a row a list
    return {r["cid"]: r["mean"] for r in rows}


def train_lists(vectors: DataFrame, lists: int = 16, rounds: int = 10, order: Column | None = None) -> list[list[float]]:
    """Centroids: cosine assignment, mean update, empty lists keep theirs.

    Every round is a pass over all vectors. The first `lists` vectors by `order` (by default the
    least hashes of vec_id) begin as centroids; the driver holds no more than these.
    """
    order = F.xxhash64("vec_id") if order is None else order
    rows = vectors.select("vec_id", "embedding", order.alias("_order")).orderBy("_order", "vec_id").limit(lists).collect()
    if len(rows) < lists:
        return []
    centroids = np.array([r["embedding"] for r in rows], dtype=np.float64)
    for _ in range(rounds):
        for c, mean in _means(vectors, centroids).items():
            centroids[c] = mean
    return centroids.tolist()


def assign(vectors: DataFrame, centroids: list[list[float]]) -> DataFrame:
    return _assigned(vectors, centroids)


def search_lists(vectors: DataFrame, assigned: DataFrame, centroids: list[list[float]], query: list[float], top: int = 10, metric: str = "cosine", probe: int = 4) -> DataFrame:
    """Exact search within the lists whose centroids have the greatest cosine with the query."""
    lists = _nearest_lists(np.array([query], dtype=np.float64), centroids, probe)[0].tolist()
    return nearest(assigned.where(F.col("cid").isin(*lists)), query, top, metric)


def _nearest_lists(q: np.ndarray, centroids: list[list[float]], probe: int) -> np.ndarray:
    return np.argsort(-np.round(_scores(q, np.array(centroids), "cosine"), 12), axis=1, kind="stable")[:, :probe]


def search_lists_many(queries: DataFrame, assigned: DataFrame, centroids: list[list[float]], top: int = 10, metric: str = "cosine", probe: int = 4) -> DataFrame:
    """search_lists for all queries (query_id, embedding) at once: (query_id, pos, vec_id, score)."""
    _metric(metric)
    parts = [_block_of_lists(ids, q, assigned, centroids, top, metric, probe) for ids, q in _blocks(queries)] if centroids else []
    return _best_of(parts, assigned.sparkSession, metric, top)


def _block_of_lists(ids: np.ndarray, q: np.ndarray, assigned: DataFrame, centroids: list[list[float]], top: int, metric: str, probe: int) -> DataFrame:
    lists = _nearest_lists(q, centroids, probe)
    asked = np.unique(lists).tolist()
    shared = assigned.sparkSession.sparkContext.broadcast((ids, q, [np.flatnonzero((lists == c).any(axis=1)) for c in range(len(centroids))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, askers = shared.value
        best = Best(len(ids), top, metric)
        for batch in batches:
            cids = batch.column(2).to_numpy()
            for c in np.unique(cids):
                here = np.flatnonzero(cids == c)
                step = _part(len(askers[c]))
                for at in range(0, len(here) if len(askers[c]) else 0, step):
                    part = batch.take(pa.array(here[at : at + step]))
                    best.take(askers[c], part.column(0).to_numpy(), np.round(_scores(q[askers[c]], _matrix(part.column(1)), metric), 6))
        yield best.rows(ids)

    return assigned.where(F.col("cid").isin(asked)).select("vec_id", "embedding", "cid").mapInArrow(run, FOUND)


class ListIndex:
    """Inverted lists in a folder: centroids, trained once, and the vectors in a directory a list.

    Searches read the directories of the lists they probe. Vectors that come later are assigned to
    the centroids there are; each insert is a version, and of a vec_id the last version counts.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/centroids").collect()  # a row a list
        self.centroids = [r["centroid"] for r in sorted(rows, key=lambda r: r["cid"])]

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int = 16, rounds: int = 10) -> ListIndex:
        spark = vectors.sparkSession
        centroids = train_lists(vectors, lists, rounds)
        spark.createDataFrame(list(enumerate(centroids)), "cid int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        index = cls(spark, path)
        index._write(vectors, 0)
        return index

    def _write(self, vectors: DataFrame, version: int) -> None:
        rows = _assigned(vectors, self.centroids).withColumn("version", F.lit(version))
        rows.repartition("cid", F.pmod(F.xxhash64("vec_id"), F.lit(16))).write.mode("append").partitionBy("version", "cid").parquet(f"{self.path}/vectors")

    def vectors(self) -> DataFrame:
        return self.spark.read.schema("vec_id bigint, embedding array<float>, version int, cid int").parquet(f"{self.path}/vectors")

    def insert(self, vectors: DataFrame) -> None:
        self._write(vectors, self.vectors().agg(F.max("version")).first()[0] + 1)

    def _current(self) -> DataFrame:
        rows = self.vectors()
        if rows.agg(F.max("version")).first()[0] == 0:
            return rows
        last = rows.where("version > 0").groupBy("vec_id").agg(F.max("version").alias("_last"))
        return rows.join(last, "vec_id", "left").where("_last IS NULL OR version = _last").drop("_last")

    def search(self, query: list[float], top: int = 10, metric: str = "cosine", probe: int = 4) -> DataFrame:
        return search_lists(self._current(), self._current(), self.centroids, query, top, metric, probe)

    def search_many(self, queries: DataFrame, top: int = 10, metric: str = "cosine", probe: int = 4) -> DataFrame:
        return search_lists_many(queries, self._current(), self.centroids, top, metric, probe)


def column_of(metric: str, a: Column, b: Column) -> Column:
    return _metric(metric)[0](a, b)
