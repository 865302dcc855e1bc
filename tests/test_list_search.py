import duckdb
import numpy as np
import pandas as pd
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import functions as F

import __spark_entry__ as entry
from polystore.operators import vectors


class Most(AccumulatorParam):
    def zero(self, value):
        return 0

    def addInPlace(self, a, b):
        return max(a, b)


def found(df):
    return {(r["query_id"], r["vec_id"]) for r in df.collect()}


def test_recall_of_the_list_search(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = found(vectors.nearest_many(asked, rows, 10))
    assert len(exact) == 10 * asked.count()
    assert len(found(entry.queries()["vec_ivf_search"](spark, small)) & exact) >= 0.9 * len(exact)


def test_all_lists_are_exact_and_few_match_the_single_search(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    centroids = vectors.train_lists(rows, 8, 2)
    assigned = vectors.assign(rows, centroids)
    asked = rows.where("vec_id IN (0, 7)").select(F.col("vec_id").alias("query_id"), "embedding")
    for metric in ("cosine", "dot", "euclidean"):
        assert found(vectors.search_lists_many(asked, assigned, centroids, 10, metric, 8)) == found(vectors.nearest_many(asked, rows, 10, metric))
    for r in asked.collect():
        one = {x["vec_id"] for x in vectors.search_lists(rows, assigned, centroids, [float(x) for x in r["embedding"]], 10, "cosine", 3).collect()}
        assert one == {v for q, v in found(vectors.search_lists_many(asked, assigned, centroids, 10, "cosine", 3)) if q == r["query_id"]}
    assert not found(vectors.search_lists_many(asked.limit(0), assigned, centroids))


def test_lists_are_trained_on_all_vectors(spark, tmp_path):
    """More vectors than 20,000, the later ones of another kind: all of them count, as in the SQL."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(24_000, 8)).round(2)
    v[20_000:, 0] += 5
    pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": list(v.astype(np.float32)), "label": 0}).to_parquet(tmp_path / "embeddings.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    for name in ("vec_ivf_assign", "vec_ivf_centroids"):
        got = sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect()))
        assert got == sorted(duckdb.sql(entry.oracle_sql()[name]).fetchall()), name


def test_scores_held_at_once_are_bounded(spark, monkeypatch):
    """A task's scores take no more memory for 4,096 queries than for few."""
    most = spark.sparkContext.accumulator(0, Most())
    scores = vectors._scores
    monkeypatch.setattr(vectors, "_scores", lambda q, v, metric: (most.add(len(q) * len(v)), scores(q, v, metric))[1])
    v = np.random.default_rng(4).normal(size=(4096, 4)).round(3)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>").coalesce(1)
    best = vectors.nearest_many(rows.withColumnRenamed("vec_id", "query_id"), rows, 2).where("pos = 1").collect()
    assert len(best) == 4096 and all(r["score"] == 1 for r in best)
    assert 0 < most.value <= 1 << 21
