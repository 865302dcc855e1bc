"""A standing full-text index: postings written once, sorted by term, and read by the terms asked for.

A folder holds segments, each with postings (doc_id, term, tf, length) in ranges of terms and with
the ids it replaces or removes. The row of a segment in `manifest`, with the totals that hold from
then on, is written last: a segment without one doesn't exist. A posting counts unless a later
segment names its document. Documents without terms aren't indexed.

A search reads the row groups of its terms. Many queries are scored in blocks: postings of the
terms asked for are dealt by document, each task multiplies blocks of documents by the block of
queries and keeps the best of each query, so that a common term costs its postings once, not once
for each query that has it.
"""

from __future__ import annotations

import posixpath
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polystore.functions.words import Terms, terms_of
from polystore.operators.fulltext import B, K1

POSTING = "doc_id bigint, term string, tf int, length int"
QUERIES, DOCS = 512, 512  # in a block
ROWS = 256  # texts a worker holds at once


def _postings(docs: DataFrame, stemming: bool) -> DataFrame:
    """POSTING, counted within each row: a document is one row, so nothing is shuffled to count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Terms(stemming)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, terms, tfs, sizes = [], [], [], []
                for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = own.of(text)
                    counted = Counter(words)
                    ids += [name] * len(counted)
                    terms += counted.keys()
                    tfs += counted.values()
                    sizes += [len(words)] * len(counted)
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.string()), pa.array(tfs, pa.int32()), pa.array(sizes, pa.int32())], names=["doc_id", "term", "tf", "length"])

    return docs.select("doc_id", "text").mapInArrow(run, POSTING)


class TextIndex:
    def __init__(self, spark: SparkSession, path: str, stemming: bool = False):
        """An index at path, a folder that all executors share; it need not exist yet."""
        self.spark, self.path, self.stemming = spark, path, stemming
        self.segments = self._manifest()

    def _at(self, *parts: str) -> str:
        return posixpath.join(self.path, *parts)

    def _manifest(self) -> list[tuple[int, int, int, bool, bool]]:
        """(segment, total_docs, total_terms, has postings, has gone) by segment."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self._at("manifest"))
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return []
        return sorted(map(tuple, self.spark.read.parquet(self._at("manifest")).collect()))  # a row a segment

    def _commit(self, docs: int, terms: int, postings: bool, gone: bool) -> None:
        row = len(self.segments), docs, terms, postings, gone
        self.spark.createDataFrame([row], "segment int, total_docs bigint, total_terms bigint, postings boolean, gone boolean").coalesce(1).write.mode("append").parquet(self._at("manifest"))
        self.segments.append(row)

    @property
    def totals(self) -> tuple[int, int]:
        return self.segments[-1][1:3] if self.segments else (0, 0)

    def postings(self, terms: list[str] | DataFrame | None = None) -> DataFrame:
        """The postings that count, of the terms if some are given."""
        found = None
        for segment, _, _, there, _ in self.segments:
            if there:
                rows = self.spark.read.schema(POSTING).parquet(self._at("postings", str(segment)))
                if isinstance(terms, list):
                    rows = rows.where(F.col("term").isin(terms))
                elif terms is not None:
                    rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
                later = [s[0] for s in self.segments if s[4] and s[0] > segment]
                if later:
                    gone = self.spark.read.schema("doc_id bigint").parquet(*[self._at("gone", str(s)) for s in later])
                    rows = rows.join(gone.distinct(), "doc_id", "left_anti")
                found = rows if found is None else found.unionByName(rows)
        return found if found is not None else self.spark.createDataFrame([], POSTING)

    def _hidden(self, ids: DataFrame) -> tuple[int, int]:
        """How many documents and terms of the index have one of the ids."""
        own = self.postings().join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("length").alias("n")).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        return int(own[0]), int(own[1])

    def add(self, docs: DataFrame) -> None:
        """Indexes documents (doc_id, text); those that are there are replaced, also by texts without terms."""
        segment, (n, total) = len(self.segments), self.totals
        ids = docs.select("doc_id").distinct()
        hidden = self._hidden(ids) if n else (0, 0)
        if hidden[0]:
            ids.write.mode("overwrite").parquet(self._at("gone", str(segment)))
        rows = _postings(docs, self.stemming)
        at = self._at("postings", str(segment))
        rows.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").option("parquet.block.size", str(8 << 20)).parquet(at)
        new = self.spark.read.schema(POSTING).parquet(at).groupBy("doc_id").agg(F.max("length").alias("n")).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        self._commit(n - hidden[0] + int(new[0]), total - hidden[1] + int(new[1]), True, bool(hidden[0]))

    def delete(self, ids: DataFrame) -> int:
        """Removes documents by doc_id; tells how many there were."""
        ids = ids.select("doc_id").distinct()
        hidden = self._hidden(ids)
        if hidden[0]:
            ids.write.mode("overwrite").parquet(self._at("gone", str(len(self.segments))))
            self._commit(self.totals[0] - hidden[0], self.totals[1] - hidden[1], False, True)
        return hidden[0]

    def search(self, query: str, top: int = 10) -> DataFrame:
        """(pos, doc_id, score): the best documents of one query; repeated terms count as often as they stand."""
        asked = Counter(terms_of(query, self.stemming))
        n, total = self.totals
        found = self.postings(list(asked)).where(F.col("tf") > 0)
        df = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.count("*").alias("df")).collect()} if asked else {}  # a row a term asked for
        weight = F.lit(0.0)
        for term, times in asked.items():
            if term in df:
                weight = F.when(F.col("term") == term, F.lit(times * float(np.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))))).otherwise(weight)
        average = total / max(1, n) or 1.0
        part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / average))
        best = found.groupBy("doc_id").agg(F.round(F.sum(part), 4).alias("score")).orderBy(F.desc("score"), "doc_id").limit(top)
        return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("bigint").alias("pos"), "doc_id", "score")

    def search_many(self, queries: DataFrame, top: int = 10) -> DataFrame:
        """(query_id, pos, doc_id, score) of all queries (query_id, text).

        The driver holds the terms of one block of queries at a time; the blocks after the first
        are run when the result is.
        """
        found = None
        for block in _blocks(queries, QUERIES, self.stemming):
            part = self._block(block, top)
            found = part if found is None else found.unionByName(part)
        if found is None:
            return self.spark.createDataFrame([], "query_id bigint, pos bigint, doc_id bigint, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return found.withColumn("pos", F.row_number().over(order).cast("bigint")).where(F.col("pos") <= top).select("query_id", "pos", "doc_id", "score")

    def _block(self, block: list[tuple[int, Counter]], top: int) -> DataFrame:
        terms = sorted({t for _, asked in block for t in asked})
        number = {t: i for i, t in enumerate(terms)}
        mine = self.postings(self.spark.createDataFrame([(t,) for t in terms], "term string"))
        df = {r["term"]: r["df"] for r in mine.groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row a term asked for
        n, total = self.totals
        weights = np.zeros((len(terms), len(block)), dtype=np.float64)
        for q, (_, asked) in enumerate(block):
            for t, times in asked.items():
                if t in df:
                    weights[number[t], q] = times * np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
        ids = np.array([q for q, _ in block], dtype=np.int64)
        shared = self.spark.sparkContext.broadcast((number, weights, ids))  # at most QUERIES queries and their terms
        average = total / max(1, n) or 1.0

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            number, weights, ids = shared.value
            best = pd.DataFrame({"query_id": ids[:0], "doc_id": ids[:0], "score": np.zeros(0)})
            held: list[pd.DataFrame] = []

            def scored(rows: pd.DataFrame) -> pd.DataFrame:
                docs, at = np.unique(rows["doc_id"].to_numpy(), return_inverse=True)
                out = [best]
                tf = rows["tf"].to_numpy(dtype=np.float64)
                value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * rows["length"].to_numpy() / average))
                term = rows["term"].map(number).to_numpy()
                for begin in range(0, len(docs), DOCS):
                    own = (at >= begin) & (at < begin + DOCS)
                    table = np.zeros((min(DOCS, len(docs) - begin), len(weights)))
                    table[at[own] - begin, term[own]] = value[own]
                    scores = np.round(table @ weights, 4).T
                    q, d = np.nonzero(scores > 0)
                    out.append(pd.DataFrame({"query_id": ids[q], "doc_id": docs[begin + d], "score": scores[q, d]}).sort_values(["query_id", "score", "doc_id"], ascending=[True, False, True]).groupby("query_id").head(top))
                return pd.concat(out).sort_values(["query_id", "score", "doc_id"], ascending=[True, False, True]).groupby("query_id").head(top)

            for rows in batches:
                if not len(rows):
                    continue
                # the last document of a batch may go on in the next one
                whole = rows["doc_id"].to_numpy() != rows["doc_id"].iloc[-1]
                if whole.any():
                    best = scored(pd.concat([*held, rows[whole]]))
                    held = []
                held.append(rows[~whole])
            if held:
                best = scored(pd.concat(held))
            yield best

        dealt = mine.repartition("doc_id").sortWithinPartitions("doc_id")
        return dealt.mapInPandas(run, "query_id bigint, doc_id bigint, score double")


def _blocks(queries: DataFrame, size: int, stemming: bool) -> Iterator[list[tuple[int, Counter]]]:
    block: list[tuple[int, Counter]] = []
    for r in queries.select("query_id", "text").toLocalIterator():
        block.append((r["query_id"], Counter(terms_of(r["text"] or "", stemming))))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block
