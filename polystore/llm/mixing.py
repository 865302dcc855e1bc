"""Mixing sources to target weights by balanced sampling with the cube method.

Each source gets a target number of words. The ratio of target to size is how often its documents
are taken: the whole part of it by every document, the fraction as the inclusion probability of one
more copy. The flight phase moves the probabilities of three documents at a time along the null
space of the two balancing constraints (number of documents, number of words), so both totals stay
as they are while each move fixes at least one document at 0 or 1. It runs on chunks of a source in
parallel; a chunk leaves at most two documents open, the open ones of a source meet again in fewer
chunks, and what remains of the last chunk, two documents at most, is landed by the least error.

Chunks are hashes of ids, so a source with a third of all rows is dealt over many tasks, and the
same table gives the same mix again. Null texts have no words; a null source is a source, the last
one; documents without words, sources without words and empty tables take nothing. Repeated rows
are mixed each, those alike in id, source and size in the order of their texts. The table of targets
has one row a source, at most MOST_SOURCES, and it alone passes through the driver.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from polystore.llm.common import WORD, cut, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
CHUNK = 2_000
NEAR = 1e-9
LANDING = 10  # documents, at most half of them, that stay out of a source's last flight and land with the two it leaves
MOST_SOURCES = 1 << 18


def targets(sizes: list[int], weights: list[float], mass: float, most: float = MOST) -> list[float]:
    """Shares mass by weight; no target above most times its size, the excess shared again by weight."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), mass
    while open_:
        per = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if per * weights[i] > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = per * weights[i]
            break
        for i in sorted(over):
            out[i] = most * sizes[i]
            left -= out[i]
        left = max(0.0, left)
        open_ -= over
    return out


def _move(p: list[float], direction: list[float], draw: float) -> list[float]:
    """One step of the flight: to an end of the line p + t * direction within the cube, means kept."""
    ahead = min((1 - x) / u if u > 0 else -x / u for x, u in zip(p, direction, strict=True) if u)
    back = min(x / u if u > 0 else (x - 1) / u for x, u in zip(p, direction, strict=True) if u)
    step = ahead if draw * (ahead + back) < back else -back
    moved = [x + step * u for x, u in zip(p, direction, strict=True)]
    return [0.0 if x < NEAR else 1.0 if x > 1 - NEAR else x for x in moved]


def flight(p: list[float], size: list[int], seed: int) -> list[float]:
    """Probabilities after the flight phase; at most two lie strictly between 0 and 1."""
    p, rng, held = list(p), random.Random(seed), []
    for k in range(len(p)):
        if not NEAR < p[k] < 1 - NEAR:
            p[k] = round(p[k])
            continue
        held.append(k)
        while len(held) == 3 or len(held) == 2 and size[held[0]] == size[held[1]]:
            if len(held) == 2 or len({size[i] for i in held}) == 1:
                direction = [1.0, -1.0, 0.0][: len(held)]
            else:
                a, b, c = (size[i] for i in held)
                direction = [float(b - c), float(c - a), float(a - b)]
            for i, x in zip(held, _move([p[i] for i in held], direction, rng.random()), strict=True):
                p[i] = x
            held = [i for i in held if 0 < p[i] < 1]
    return p


def land(p: list[float], size: list[int]) -> list[float]:
    """Rounds the open probabilities, a few, so that the words come closest, then the documents."""
    p = list(p)
    open_ = [i for i, x in enumerate(p) if 0 < x < 1]
    part, weigh = np.array([p[i] for i in open_]), np.array([size[i] for i in open_], dtype=float)
    choices = np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1
    words, count = np.abs(choices @ weigh - part @ weigh), np.abs(choices.sum(axis=1) - part.sum())
    best = choices[np.lexsort((np.arange(len(choices)), count, words))[0]]
    for i, x in zip(open_, best, strict=True):
        p[i] = float(x)
    return p


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"))


def source_targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, place, n_rows) by source."""
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources: mix groups of them")
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["s"] or 0) for r in found]
    goal = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(sizes))], share * sum(sizes), most)
    schema = StructType([StructField("source", StringType()), StructField("source_size", LongType()), StructField("target", DoubleType()), StructField("place", LongType()), StructField("n_rows", LongType())])
    return spark.createDataFrame([(r["source"], s, float(g), i, int(r["n"])) for i, (r, s, g) in enumerate(zip(found, sizes, goal, strict=True))], schema)


def _flown(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["order", "doc_id", "size"], kind="stable")
    size = [int(x) for x in pdf["size"]]
    p, seed = list(pdf["p"]), int(pdf["place"].iloc[0]) * 1_000_003 + int(pdf["chunk"].iloc[0])
    if pdf["chunks"].iloc[0] > 1:
        return pdf.assign(p=flight(p, size, seed))
    flying = len(p) - min(LANDING, len(p) // 2)
    return pdf.assign(p=land(flight(p[:flying], size[:flying], seed) + p[flying:], size))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source) of each row."""
    rows = cut(sized(docs))
    goal = source_targets(rows, weights, share, most)
    longest = max([0, *(r["n_rows"] for r in goal.collect())])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    open_ = (
        rows.join(goal, rows["source"].eqNullSafe(goal["source"]), "inner")
        .select("doc_id", "size", "source_size", "target", "place", rows["source"], ratio.alias("ratio"), F.ceil(F.col("n_rows") / chunk).cast("long").alias("chunks"))
        .withColumn("whole", F.floor("ratio").cast("long"))
        .withColumn("p", F.col("ratio") - F.col("whole"))
        .withColumn("order", F.xxhash64("doc_id", "size"))
        .drop("ratio")
        .withColumn("chunk", F.pmod("order", F.col("chunks")))
    )
    schema = open_.schema
    done, chunks = [], max(1, math.ceil(longest / chunk))
    while True:
        flown = open_.groupBy("place", "chunk").applyInPandas(_flown, schema)
        if chunks == 1:
            done.append(flown)
            break
        flown = cut(flown)
        between = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(flown.where(~between))
        # a chunk left two rows at most
        open_ = flown.where(between).withColumn("chunks", F.ceil(F.col("chunks") * 2 / chunk).cast("long")).withColumn("chunk", F.pmod(F.xxhash64("order"), F.col("chunks"))).select(schema.names)
        chunks = math.ceil(chunks * 2 / chunk)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("whole") + F.round("p").cast("long")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents as the mix takes them: none, one or more rows of each, with its columns."""
    names = docs.columns
    key = ["_id", "_source", "_size"]
    own = docs.withColumns({"_id": F.col("doc_id"), "_source": F.col("source").cast("string"), "_size": F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")})
    plan = mix(docs, **settings).groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    # rows alike in id, source and size share their copies
    own = own.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy("text")))
    same = [own[k].eqNullSafe(plan[k]) for k in key]
    taken = own.join(plan, same[0] & same[1] & same[2], "inner")
    times = F.floor(F.col("_copies") / F.col("_rows")).cast("int") + (F.col("_place") <= F.col("_copies") % F.col("_rows")).cast("int")
    return taken.select(*[own[n] for n in names], F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))).alias("_time")).drop("_time")
