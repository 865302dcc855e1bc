"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training takes a sample of labelled documents, bounded in number and in features (both are
parameters), as one task that any executor can repeat: the ids are drawn from the labels by a hash, broadcast (at most the
bound) and joined to the documents, so that texts aren't shuffled to find the labelled ones. Each
coordinate has its own rate, and L1 leaves most weights at zero; what remains is broadcast, at most
one weight for each of the 2**BITS coordinates (12 MB), for scoring, which is one pass without a
shuffle.

Features of a text are the hashes of its lower-cased words, pairs of neighbours, and pairs with one
word between them, each once. Labels, languages, sources and ids are no features. Null and empty
texts score the bias alone; null labels and ids don't train; without training rows all scores are
0.5; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polystore.llm.common import map_rows

SAMPLE, ENTRIES = 20_000, 50_000_000  # documents and features that train
BITS = 20
BIAS = 1 << BITS
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 1.0
#: ASCII punctuation and controls become spaces.
TO_SPACE = bytes(b if b >= 128 or chr(b).isalnum() or b == 95 else 32 for b in range(256))
#: Odd multipliers that tell the kinds of features apart.
ONE, PAIR_A, PAIR_B, SKIP_A, SKIP_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
SHIFT = np.uint64(64 - BITS)


def features(text: str | None) -> np.ndarray:
    from xxhash import xxh64_intdigest

    tokens = (text or "").lower().encode().translate(TO_SPACE).split()
    if not tokens:
        return np.zeros(0, dtype=np.int32)
    h = np.fromiter(map(xxh64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
    keys = np.concatenate([h * ONE, (h[:-1] * PAIR_A + h[1:]) * PAIR_B, (h[:-2] * SKIP_A + h[2:]) * SKIP_B])
    return np.unique((keys >> SHIFT).astype(np.int32))


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else 1 - 1 / (1 + math.exp(x))


class Ftrl:
    """Per-coordinate FTRL-proximal; the last coordinate is the bias, which L1 spares."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == BIAS, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = sigmoid(float(w.sum())) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) that aren't zero."""
    model, bias = Ftrl(), np.array([BIAS])
    for _ in range(epochs):
        for at, label in rows:
            model.learn(np.concatenate([at, bias]), label)
    every = np.arange(BIAS + 1)
    w = model.weights(every)
    return every[w != 0], w[w != 0]


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label_col: str, sample: int = SAMPLE, epochs: int = EPOCHS, entries: int = ENTRIES) -> tuple[np.ndarray, np.ndarray]:
    """Weights from at most `sample` labelled documents that aren't held out, drawn by the hash of their ids.

    Features are hashed where the texts are; the training task holds at most `entries` of them and
    leaves out documents that would exceed it, and all rows but one of a doc_id.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out())
        .select("doc_id", F.col(label_col).cast("int").alias("label"), F.xxhash64("doc_id").alias("turn"))
        .orderBy("turn", "doc_id", "label")
        .limit(sample)
    )
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).join(F.broadcast(chosen), "doc_id").select("turn", "doc_id", "label", "tie", "text")

    def make():
        return lambda batch: [(r["turn"], r["doc_id"], r["label"], r["tie"], features(r["text"]).tolist()) for r in batch]

    hashed = map_rows(rows, make, "turn long, doc_id long, label int, tie long, at array<int>")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, total, last = [], 0, None
        for batch in batches:
            for name, label, at in zip(batch["doc_id"], batch["label"], batch["at"], strict=True):
                if name != last and total + len(at) <= entries:
                    seen.append((np.asarray(at, dtype=np.int32), int(label)))
                    total += len(at)
                last = name
        at, w = fit(seen, epochs) if seen else (np.zeros(0, dtype=np.int64), np.zeros(0))
        yield pd.DataFrame({"at": at, "w": w})

    dealt = hashed.repartition(1).sortWithinPartitions("turn", "doc_id", "label", "tie").select("doc_id", "label", "at")
    found = dealt.mapInPandas(run, "at long, w double").toPandas()
    return found["at"].to_numpy(), found["w"].to_numpy()


def score_documents(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted) of each row."""
    at, w = weights
    shared = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), w.astype(np.float64)))

    def make():
        own_at, own_w = shared.value
        dense = np.zeros(BIAS + 1)
        dense[own_at] = own_w

        def work(rows):
            out = []
            for r in rows:
                s = sigmoid(float(dense[features(r["text"])].sum() + dense[BIAS]))
                out.append((r["doc_id"], s, int(s >= threshold)))
            return out

        return work

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs."""
    weights = train(docs, labels, label_col, sample)
    return score_documents(docs, weights).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
