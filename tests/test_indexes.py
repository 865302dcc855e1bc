"""Standing indexes against searches over the raw tables."""

import numpy as np
from pyspark.sql import functions as F

from polystore.operators import fulltext, vectors
from polystore.operators.text_index import TextIndex

DOCS = "doc_id bigint, text string"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_text_index(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    index = TextIndex(spark, str(tmp_path / "text"))
    assert index.search("tion").count() == 0
    index.add(docs)
    for query in ("tion thble thor", "tion tion", "nothing-has-this", "the"):
        assert rows_of(index.search(query, 15)) == rows_of(fulltext.search(docs, query, 15)), query
    # replaced, emptied, added and deleted documents
    ids = [r[0] for r in docs.select("doc_id").orderBy("doc_id").limit(4).collect()]
    new = spark.createDataFrame([(ids[0], "thor thor tion"), (ids[1], "the"), (10**9, "thor alone")], DOCS)
    index.add(new)
    assert index.delete(spark.createDataFrame([(ids[2],), (10**10,)], "doc_id bigint")) == 1
    now = docs.where(~F.col("doc_id").isin(ids[:3])).unionByName(new)
    again = TextIndex(spark, str(tmp_path / "text"))  # as it stands in the folder
    stats = fulltext.statistics(fulltext.lengths(now)).first()
    assert again.totals == (stats["total_docs"], stats["total_terms"])
    assert rows_of(again.search("tion thor", 15)) == rows_of(fulltext.search(now, "tion thor", 15))
    asked = {1: "tion thor", 2: "thble", 3: "nothing-has-this", 4: "thor thor"}
    queries = spark.createDataFrame(list(asked.items()), "query_id bigint, text string")
    want = fulltext.search_many(fulltext.query_terms(spark, asked), fulltext.postings(now), fulltext.lengths(now), 7)
    assert rows_of(again.search_many(queries, 7)) == rows_of(want)


def test_stemmed_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "connected relations"), (2, "connecting nothing"), (3, "others")], DOCS)
    index = TextIndex(spark, str(tmp_path / "stems"), stemming=True)
    index.add(docs)
    assert [r["doc_id"] for r in index.search("connection relation").collect()] == [r["doc_id"] for r in fulltext.search(docs, "connection relation", stemming=True).collect()]
    assert rows_of(index.search("connects")) == rows_of(fulltext.search(docs, "connects", stemming=True))


def test_list_index(spark, small, tmp_path):
    v = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding")
    index = vectors.ListIndex.build(v, str(tmp_path / "lists"), lists=8)
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = rows_of(vectors.nearest_many(asked, v, 5))
    assert rows_of(index.search_many(asked, 5, probe=8)) == exact
    query = [float(x) for x in v.first()["embedding"]]
    assert rows_of(index.search(query, 5, probe=8)) == rows_of(vectors.nearest(v, query, 5))
    index.insert(spark.createDataFrame([(10**6, query), (v.first()["vec_id"], [-x for x in query])], "vec_id bigint, embedding array<float>"))
    found = index.search(query, 3, probe=8).collect()
    assert found[0]["vec_id"] == 10**6 and all(r["vec_id"] != v.first()["vec_id"] for r in found)


def test_best_of_parts():
    rng = np.random.default_rng(5)
    for metric in ("cosine", "dot", "euclidean"):
        scores = rng.integers(0, 6, size=(4, 300)).astype(float)  # many ties
        best = vectors.Best(4, 7, metric)
        for at in range(0, 300, 45):
            best.take(np.arange(4), np.arange(at, min(300, at + 45)), scores[:, at : at + 45])
        got = best.rows(np.arange(4)).to_pydict()
        for q in range(4):
            want = sorted(range(300), key=lambda i: (scores[q, i] if metric == "euclidean" else -scores[q, i], i))[:7]
            assert [v for k, v in zip(got["query_id"], got["vec_id"], strict=True) if k == q] == want
