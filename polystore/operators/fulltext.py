"""Full text: postings, statistics, BM25 search and snippets."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polystore.functions.words import Terms, is_term, raw_tokens, stemmed, terms_of

K1, B = 1.5, 0.75


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, term) of every occurrence."""
    return docs.select("doc_id", F.explode(raw_tokens(F.col("text"))).alias("term")).where(is_term(F.col("term")))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(term, stem): each distinct term is stemmed once."""
    return tokens(docs).select("term").distinct().withColumn("stem", stemmed("term"))


def postings(docs: DataFrame, stemming: bool = False) -> DataFrame:
    """(doc_id, term, tf)."""
    counted = tokens(docs).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    if not stemming:
        return counted
    stems = counted.select("term").distinct().withColumn("stem", stemmed("term"))
    return counted.join(stems, "term").groupBy("doc_id", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, length) of documents with terms: no explode, no shuffle."""
    return docs.select("doc_id", F.size(F.filter(raw_tokens(F.col("text")), is_term)).cast("bigint").alias("length")).where("length > 0")


def statistics(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.count("*").alias("total_docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_terms"))


def document_frequency(found: DataFrame) -> DataFrame:
    return found.groupBy("term").agg(F.count("*").alias("df"))


def _score(tf: Column, df: Column, length: Column, n: Column, average: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def search_many(queries: DataFrame, found: DataFrame, sizes: DataFrame, top: int = 10) -> DataFrame:
    """(query_id, pos, doc_id, score): the best documents of each query (query_id, term, times).

    The terms asked for restrict the postings before anything else meets; the query side is
    broadcast only as the planner's size limit allows.
    """
    asked = queries.select("term").distinct()
    mine = found.join(asked, "term", "left_semi")
    df = document_frequency(mine)
    totals = statistics(sizes).withColumn("average", F.col("total_terms") / F.greatest(F.lit(1), F.col("total_docs")))
    scored = (
        mine.join(df, "term")
        .join(sizes, "doc_id")
        .join(queries, "term")
        .crossJoin(F.broadcast(totals))  # one row
        .groupBy("query_id", "doc_id")
        .agg(F.round(F.sum(F.col("times") * _score(F.col("tf"), F.col("df"), F.col("length"), F.col("total_docs"), F.col("average"))), 4).alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= top).select("query_id", F.col("pos").cast("bigint").alias("pos"), "doc_id", "score")


def query_terms(spark, texts: dict, stemming: bool = False) -> DataFrame:
    """(query_id, term, times) of given query texts; a repeated term counts as often as it stands."""
    rows = [(q, t) for q, text in texts.items() for t in terms_of(text, stemming)]
    return spark.createDataFrame(rows, "query_id bigint, term string").groupBy("query_id", "term").agg(F.count("*").alias("times"))


def _counted(docs: DataFrame, asked: list[str], stemming: bool) -> DataFrame:
    """(doc_id, length, tf) of documents with terms; tf counts each term asked for. One pass over the words of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(stemming)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [terms.of(t) for t in part.column(1).to_pylist()]
                there = [k for k, words in enumerate(found) if words]
                tf = [[found[k].count(t) for t in asked] for k in there]
                columns = [part.column(0).take(pa.array(there, pa.int64())), pa.array([len(found[k]) for k in there], pa.int64()), pa.array(tf, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "length", "tf"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, length long, tf array<long>")


def search(docs: DataFrame, query: str, top: int = 10, stemming: bool = False) -> DataFrame:
    """(pos, doc_id, score) of one query over texts: one pass for the statistics, one for the scores, no shuffle of postings.

    For more than a query, build a TextIndex.
    """
    asked = terms_of(query, stemming)
    distinct = list(dict.fromkeys(asked))
    counted = _counted(docs, distinct, stemming)
    tf = [F.col("tf")[i] for i in range(len(distinct))]
    told = counted.agg(F.count("*").alias("n"), F.sum("length").alias("total"), *[F.count_if(t > 0).alias(f"df{i}") for i, t in enumerate(tf)]).first()
    n, average = told["n"], (told["total"] or 0) / max(1, told["n"])
    total = F.lit(0.0)
    for i, t in enumerate(distinct):
        total = total + F.lit(float(asked.count(t))) * F.when(tf[i] > 0, _score(tf[i], F.lit(told[f"df{i}"]), F.col("length"), F.lit(n), F.lit(average or 1.0))).otherwise(0.0)
    best = counted.where(F.exists("tf", lambda t: t > 0)).select("doc_id", F.round(total, 4).alias("score")).orderBy(F.desc("score"), "doc_id").limit(top)
    order = Window.orderBy(F.desc("score"), "doc_id")  # over the page only
    return best.select(F.row_number().over(order).cast("bigint").alias("pos"), "doc_id", "score")


def snippet_of(text: str, query: str, length: int = 160) -> str:
    """The stretch of a text with most of the query's words, each in bold.

    Every word of the text begins a window; the first one that holds the most counts, and the
    stretch begins 20 characters before it.
    """
    words = sorted(set(re.findall(r"\w+", query.lower())), key=lambda w: (-len(w), w))
    low = text.lower()
    places = [(len(w), [m.start() for m in re.finditer(f"(?={re.escape(w)})", low)]) for w in words]
    best, most = 0, 0
    for m in re.finditer(r"\w+", low):
        begin, held = m.start(), 0
        for n, at in places:
            k = bisect_left(at, begin)
            held += k < len(at) and at[k] + n <= begin + length
        if held > most:
            best, most = begin, held
    start = max(0, best - 20)
    end = min(len(text), start + length)
    part = text[start:end].strip()
    if words:
        part = re.sub("|".join(map(re.escape, words)), lambda m: f"<b>{m[0]}</b>", part, flags=re.IGNORECASE)
    return ("..." if start > 0 else "") + part + ("..." if end < len(text) else "")


def with_snippets(hits: DataFrame, docs: DataFrame, query: str, length: int = 160) -> DataFrame:
    """hits with a snippet; texts are fetched for the hits alone."""

    @F.pandas_udf("string")
    def shown(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet_of(t or "", query, length))

    return docs.join(F.broadcast(hits), "doc_id").select(*hits.columns, shown("text").alias("snippet"))
