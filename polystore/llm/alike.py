"""Documents alike in their shingles: groups of texts linked by a Jaccard similarity of at least LIKE.

A text is the set of its runs of `shingle` words (A-Z lower-cased), or of its whole sequence if it
is shorter; texts without words are alike. Candidates come from two indexes: SimHash's one-wildcard variants, which give the pairs within two
bits, and, since that is far closer than LIKE, BANDS keys, each of ROWS least hashes of the set. A
pair alike in 0.8 shares none of these with a chance of (1 - 0.8 ** 4) ** 24, about three in a
million, and any more alike pair with less. Each candidate is verified on the texts.

Under a key, texts stand in the order of how many others share their keys, which puts those first
that a crowd of near copies derives from. Each text pairs with the first of them and with the one
before it. Two texts alike in 0.8 differ from each other in a ninth of their shingles, so a text
with edits of its own can only be like those with few, which are among the first. Keys whose texts
this leaves in several components go on to more of the first texts, in ROUNDS. Of keys that still
have several components all texts of different components are compared in blocks, by their shingles,
but for those that can't be alike: texts of which over a fifth of the shingles stand in no other
text there, and pairs too unlike in size. Keys of over a block of texts have the former taken out
before they are dealt. So the order only spares work: all pairs that share a key and could join two
components are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polystore.llm.common import BLOCK, cut, key_filter, map_rows, may_be_in, maybe_in, met_in_blocks, slices, text_or_empty, with_texts
from polystore.llm.components import components

BANDS, ROWS = 24, 4
ROUNDS = ((0, 4), (4, 16))  # of the first texts of a key, those that a round pairs with
LIKE = (4, 5)  # as a fraction
SEED = 42
_RANDOM = np.random.default_rng(SEED).integers(1 << 64, size=(2, BANDS * ROWS), dtype=np.uint64)
ODD, FLIP = _RANDOM[0] | np.uint64(1), _RANDOM[1]
FOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: lower-cases and splits by ASCII only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    parts = (b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1)))
    return np.unique(np.fromiter((xxh64_intdigest(p, SEED) for p in parts), dtype=np.uint64))


def band_keys(s: np.ndarray) -> np.ndarray:
    """The keys of a set, one a band."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(s), 4096):
        least = np.minimum(least, ((s[None, at : at + 4096] ^ FLIP[:, None]) * ODD[:, None]).min(axis=1))
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = (out ^ column) * FOLD
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LIKE[1] * both >= LIKE[0] * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """Of (a, b), hashes of texts: those that are alike."""

    def verify():
        held: dict[int, np.ndarray] = {}

        def of(name, text):
            if name not in held:
                if len(held) >= 256:
                    held.clear()
                held[name] = shingle_set(text, shingle)
            return held[name]

        return lambda batch: [(r["a"], r["b"]) for r in batch if alike(of(r["a"], r["text_a"]), of(r["b"], r["text_b"]))]

    return cut(map_rows(with_texts(pairs, rows), verify, "a long, b long"))


def _stars(low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b), a < b, of (key, hash, root) sorted by key: each text with those in places low..high - 1 of its key and, in the first round, with the one before.

    Pairs of one root are left out. The first `high` texts of a key and the last one stay in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, dtype=np.int64)] * 3
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(kept[0])
            columns = [np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(kept)]
            key, text, root = columns
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            begin = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            rank = np.arange(len(key)) - begin
            fresh = np.arange(len(key)) >= old
            pairs = []
            for place in range(low, high):
                own = np.flatnonzero(fresh & (rank > place))
                pairs.append((own, begin[own] + place))
            if not low:
                own = np.flatnonzero(fresh & (rank > high))
                pairs.append((own, own - 1))
            stay = np.flatnonzero((begin == begin[-1]) & ((rank < high) | (np.arange(len(key)) == len(key) - 1)))
            kept = [c[stay] for c in columns]
            x, y = (np.concatenate(p) for p in zip(*pairs, strict=True))
            good = (root[x] != root[y]) & (text[x] != text[y])
            a, b = text[x[good]], text[y[good]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _linked(columns: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of pairs of rows (hash, root, shingles) of one key: links (a, b) of those alike that connect their roots."""
    text, root, sets = columns["hash"], columns["root"], columns["shingles"]
    n = np.array([len(s) for s in sets])
    spot, number = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.repeat(root, n)
    low, high = np.full(len(spot), np.iinfo(np.int64).max), np.full(len(spot), np.iinfo(np.int64).min)
    np.minimum.at(low, number, own)
    np.maximum.at(high, number, own)
    p = np.bincount(np.repeat(np.arange(len(n)), n), weights=(low < high)[number], minlength=len(n)).astype(np.int64)  # those that other roots have too
    both = np.minimum(p[x], p[y])  # at most
    good = (root[x] != root[y]) & (text[x] != text[y]) & (LIKE[1] * both >= LIKE[0] * (n[x] + n[y] - both))
    parent: dict[int, int] = {}

    def top(r: int) -> int:
        while (up := parent.get(r, r)) != r:
            parent[r] = parent.get(up, up)
            r = up
        return r

    out: list[tuple[int, int]] = []
    for i, j in zip(x[good].tolist(), y[good].tolist(), strict=True):
        u, v = top(root[i]), top(root[j])
        if u != v and alike(sets[i], sets[j]):
            parent[u] = v
            out.append((min(text[i], text[j]), max(text[i], text[j])))
    return list(np.array(out, dtype=np.int64).reshape(-1, 2).T)


def _texts(placed: DataFrame, rows: DataFrame) -> DataFrame:
    """(hash, text) of the texts of placed, from rows."""
    told = key_filter(placed.select(F.col("hash").alias("key")))
    return maybe_in(rows.select("hash", "text"), F.col("hash"), told).groupBy("hash").agg(F.first("text").alias("text"))


def _with_partners(placed: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """The rows of placed (key, hash, root) whose texts have enough shingles that stand in other texts of placed too to be alike to one."""

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [shingle_set(t, shingle) for t in part.column(1).to_pylist()]
                many = np.array([len(x) for x in found])
                columns = np.repeat(part.column(0).to_numpy(), many), np.repeat(many, many), np.concatenate(found).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hash", "n", "spot"])

    own = cut(_texts(placed, rows)).mapInArrow(spots, "hash long, n long, spot long")
    shared = key_filter(own.groupBy("spot").agg(F.min("hash").alias("x"), F.max("hash").alias("y")).where("x < y").select(F.col("spot").alias("key")))
    able = maybe_in(own, F.col("spot"), shared).groupBy("hash").agg(F.first("n").alias("n"), F.count("*").alias("p")).where(f"{LIKE[1]} * p >= {LIKE[0]} * n")
    return cut(placed.join(able, "hash", "left_semi").select("key", "hash", "root"))


def _in_blocks(placed: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """Links (a, b) between the texts of different roots under each key of placed (key, hash, root)."""

    def make():
        return lambda batch: [(r["hash"], shingle_set(r["text"], shingle).view(np.int64)) for r in batch]

    large = key_filter(placed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key"))
    dealt = cut(may_be_in(placed.select("key", "hash", "root"), F.col("key"), large, "large"))
    few, many = (dealt.where(x).drop("large") for x in ("NOT large", "large"))
    if not many.isEmpty():
        few = few.union(_with_partners(many, rows, shingle))
    sets = map_rows(_texts(few, rows), make, "hash long, shingles array<long>")
    return cut(met_in_blocks(cut(few.join(sets, "hash").select("key", "hash", "root", "shingles")), _linked, "a long, b long").distinct())


def links(rows: DataFrame, shingle: int, near: DataFrame) -> DataFrame:
    """Edges (a, b) that connect texts (hash, text) that are alike, by their hashes; near: more candidates (a, b)."""

    def make():
        return lambda batch: [(r["hash"], band_keys(shingle_set(r["text"], shingle)).tolist()) for r in batch]

    keyed = map_rows(rows.select("hash", "text"), make, "hash long, keys array<long>")
    index = cut(keyed.groupBy("hash").agg(F.first("keys").alias("keys")).select("hash", F.explode("keys").alias("key")))
    sizes = cut(index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    # the keys that two texts have, each with how far its text's keys are shared
    own = index.join(sizes, "key").groupBy("hash").agg(F.collect_list("key").alias("keys"), F.sum(F.log2("n")).alias("shared"))
    shared = cut(own.select("hash", F.explode("keys").alias("key"), F.col("shared").cast("float")))
    partitions = max(8, rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    placed, found, tried = shared.withColumn("root", F.col("hash")), None, None
    for low, high in ROUNDS:
        dealt = placed.repartition(partitions, "key").sortWithinPartitions("key", F.desc("shared"), "hash").select("key", "hash", "root")
        pairs = dealt.mapInArrow(_stars(low, high), "a long, b long")
        if tried is None:
            tried = cut(pairs.union(near.select("a", "b")).distinct())
            found = _verified(tried, rows, shingle)
        else:
            more = cut(pairs.distinct().join(tried, ["a", "b"], "left_anti"))
            tried = tried.union(more)
            found = found.union(_verified(more, rows, shingle))
        # only keys that have texts beyond those compared so far, in several components
        roots = components(found).withColumnRenamed("node", "hash")
        placed = cut(shared.join(roots, "hash", "left").withColumn("root", F.coalesce("root", "hash")))
        open_ = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where(f"x < y AND n > {high + 1}")
        placed = cut(maybe_in(placed, F.col("key"), key_filter(open_.select("key"))))
        if placed.isEmpty():
            return found
    return found.union(_in_blocks(placed, rows, shingle))


def groups(docs: DataFrame, shingle: int, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, component_id) of each row; component_id: the least doc_id that can be reached over links.

    near gives candidates (a, b) of rows (hash, text), beside those of the bands.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("hash"))
    nodes = rows.groupBy("hash").agg(F.min("doc_id").alias("least"))
    named = rows.select("hash", "text")
    roots = components(links(named, shingle, near(named))).withColumnRenamed("node", "hash")
    member = cut(nodes.join(roots, "hash", "left").withColumn("root", F.coalesce("root", "hash")))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "hash").join(member.join(least, "root").select("hash", "component_id"), "hash").select("doc_id", "component_id")
