"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits link when they differ in at most two. Cut in two segments, two linked
fingerprints have one segment that differs by at most one bit. Each distinct fingerprint is
therefore indexed under its 64 one-wildcard variants (a segment with one bit masked); equal
variants are joined and the pairs verified. A pair that shares several variants is verified at the
first of them only.

A variant that more than HOT distinct fingerprints share isn't joined pairwise. Its members go
another exact way: each is listed under itself and its 64 one-bit neighbours, so that two
fingerprints meet at one of these points if and only if they differ in at most two bits; the at
most 65 that meet are all linked, and a star to the least of them keeps their connections.

Words are runs of non-white-space of the text with A-Z lower-cased; shingles are of `shingle` words,
repeats included, or the whole sequence if it is shorter. Null texts and texts without words have
the fingerprint zero, which is linked like any other. Equal fingerprints are one node, so copies
never meet pairwise. Repeated rows are kept; a null doc_id is no component's least id unless
there is no other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polystore.llm.alike import groups
from polystore.llm.common import cut, map_rows
from polystore.llm.components import components

SEED = 42
DISTANCE = 2
SEGMENT = 32
HOT = 8


def fingerprint(text: str | None, shingle: int) -> int:
    """Unsigned; a bit is 1 if it is set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: lower-cases and splits by ASCII only
    if not words:
        return 0
    parts = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [b" ".join(words)]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(parts), 4096):
        hashes = np.array([xxh64_intdigest(p, SEED) for p in parts[at : at + 4096]], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(parts), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp as a signed long of the same bits."""

    def make():
        def work(rows):
            out = []
            for r in rows:
                fp = fingerprint(r["text"], shingle)
                out.append((r["doc_id"], fp - (1 << 64) if fp >> 63 else fp))
            return out

        return work

    return map_rows(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), make, "doc_id long, fp long")


LOW = (1 << SEGMENT) - 1


def variants(fps: DataFrame) -> DataFrame:
    """(fp, key): the one-wildcard variants of each fingerprint; a key holds the place of the wildcard and the masked segment."""
    partitions = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # many small tasks, since each row becomes 64; dealt by another hash than the grouping before, or AQE would join them again
    rows = fps.repartition(partitions, F.xxhash64("fp", F.lit(1))).select("fp", F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENT - 1))).alias("k"))
    masked = F.expr(f"CASE WHEN k < {SEGMENT} THEN fp & {LOW}L ELSE shiftrightunsigned(fp, {SEGMENT}) END & ~shiftleft(1L, k % {SEGMENT})")
    return rows.select("fp", F.expr(f"shiftleft(CAST(k AS BIGINT), {SEGMENT})").bitwiseOR(masked).alias("key"))


#: The first variant that x and y share, and whether they link.
FIRST_SHARED = f"""
    CASE WHEN bit_count((x ^ y) & {LOW}L) <= 1
         THEN CASE WHEN (x ^ y) & {LOW}L = 0 THEN 0 ELSE bit_count(((x ^ y) & {LOW}L) - 1) END
         ELSE {SEGMENT} + CASE WHEN shiftrightunsigned(x ^ y, {SEGMENT}) = 0 THEN 0 ELSE bit_count(shiftrightunsigned(x ^ y, {SEGMENT}) - 1) END END
"""


def _verified(pairs: DataFrame) -> DataFrame:
    """Of (x, y, key): the links, each at the first variant its ends share."""
    return pairs.where(F.expr(f"bit_count(x ^ y) <= {DISTANCE} AND shiftright(key, {SEGMENT}) = {FIRST_SHARED}")).select(F.col("x").alias("a"), F.col("y").alias("b"))


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (fp, distinct) that link; of crowds, enough to connect them."""
    index = variants(fps)
    shared = cut(index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("x"), F.max("fp").alias("y")).where("n > 1"))
    two = shared.where("n = 2").select("x", "y", "key")
    some = (
        index.join(shared.where(f"n > 2 AND n <= {hot}").select("key"), "key")
        .groupBy("key")
        .agg(F.array_sort(F.collect_list("fp")).alias("all"))
        .select("key", F.posexplode("all").alias("i", "x"), "all")
        .select("key", "x", F.explode(F.expr("slice(all, i + 2, size(all))")).alias("y"))
    )
    crowd = index.join(shared.where(f"n > {hot}").select("key"), "key", "left_semi").select("fp").distinct()
    points = crowd.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("k")).select("fp", F.expr("CASE WHEN k < 0 THEN fp ELSE fp ^ shiftleft(1L, k) END").alias("point"))
    met = points.groupBy("point").agg(F.array_sort(F.collect_list("fp")).alias("all")).where("size(all) > 1")
    stars = met.select(F.explode(F.expr("slice(all, 2, size(all))")).alias("a"), F.expr("all[0]").alias("b"))
    return _verified(two).union(_verified(some)).union(stars)


def near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row; component_id: the least doc_id that can be reached over links."""
    rows = cut(fingerprints(docs, shingle, id_col, text_col))
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(fps.select("fp")))
    member = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = member.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def candidates(rows: DataFrame, shingle: int) -> DataFrame:
    """Pairs (a, b), a < b, of texts (hash, text): the links of their fingerprints, and equal fingerprints by the least text of each."""
    fps = cut(fingerprints(rows, shingle, id_col="hash").select(F.col("doc_id").alias("hash"), "fp").distinct())
    least = cut(fps.groupBy("fp").agg(F.min("hash").alias("a")))
    equal = fps.join(least, "fp").where("hash <> a").select("a", F.col("hash").alias("b"))
    found = links(fps.select("fp").distinct()).distinct()
    met = found.join(least.select(F.col("fp").alias("a"), F.col("a").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("a").alias("y")), "b")
    return equal.union(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def one_of_each(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The documents that stand for their group: of each group alike the row of the least doc_id, with all columns.

    Texts alike in 0.8 of their shingles are a group. Links of fingerprints are the first candidates;
    within DISTANCE they are far more alike than 0.8, so that shared least hashes give the others, and
    all are verified on the shingles (alike.py). Of repeated rows with that doc_id one stays, the one
    of the least text.
    """
    names, key = docs.columns, ["_id", "_none"]
    keyed = {"_id": F.coalesce(F.col("doc_id"), F.lit(0)), "_none": F.col("doc_id").isNull()}
    alike = groups(docs, shingle, lambda rows: candidates(rows, shingle))
    kept = alike.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).withColumns(keyed).select(*key).distinct()
    # the join and the window share one exchange of the texts
    stays = docs.withColumns(keyed).join(kept, key, "left_semi")
    return stays.withColumn("_turn", F.row_number().over(Window.partitionBy(*key).orderBy("text"))).where("_turn = 1").select(*names)
