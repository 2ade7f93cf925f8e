"""Toxicity from a factorization machine over hashed terms.

The terms of a text are its lower-case words and the first bytes of each word, hashed. The
machine adds to the linear weights the products of learnt term vectors, so that two terms
which are harmless alone (a mild insult, the name of a group) can weigh together.

Defined cases: a null or empty text has no terms and gets the probability of the bias alone;
without labels of both classes every text scores the share of toxic labels, 0 if there is
none. One row out for each row in, whatever repeats.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline.llm.sampling import labelled_sample, remainder
from leadline.llm.text import blocks, hashes, words

PARTS, HELD_OUT = 5, 0
PER_CLASS = 6000       # labelled texts of each class learnt from
MAX_BYTES = 65_536     # longer labelled texts are not learnt from
BUCKETS = 1 << 18
STARTS = (4, 5)        # bytes of a word's beginning that are terms of their own
FACTORS = 8
LEAST_TEXTS, LEAST_CHI2 = 4, 10.8   # what a term needs in the sample to get weights
EPOCHS, BATCH, RATE, DECAY = 15, 256, 0.1, 2e-4
THRESHOLD = 0.5


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, term) pairs of a block, sorted by text."""
    data, starts, ends, first = words(texts)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(first))
    found = [(row, hashes(data, starts, ends))]
    for size in STARTS:
        longer = ends - starts > size
        found.append((row[longer], hashes(data, starts[longer], starts[longer] + size)
                      ^ np.uint64(size)))
    rows = np.concatenate([r for r, _ in found])
    of = np.concatenate([h for _, h in found]) % np.uint64(BUCKETS)
    return rows, of.astype(np.int64)


def distinct(rows: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = np.unique(rows * BUCKETS + of)
    return pair // BUCKETS, pair % BUCKETS


@dataclass
class Machine:
    """Bias, linear weights, vectors, and the terms that have them."""

    bias: float
    linear: np.ndarray
    vectors: np.ndarray
    known: np.ndarray

    def margin(self, rows: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """Bias + linear part + pairwise part for texts 0..n-1 with distinct terms."""
        total = self.bias + np.bincount(rows, self.linear[of], n)
        for k in range(self.vectors.shape[1]):
            v = self.vectors[of, k]
            total += 0.5 * (np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n))
        return total

    def score(self, texts: pa.Array) -> np.ndarray:
        rows, of = terms(texts)
        keep = self.known[of]
        rows, of = distinct(rows[keep], of[keep])
        return 1 / (1 + np.exp(-np.clip(self.margin(rows, of, len(texts)), -30, 30)))


def train(y: np.ndarray, rows: np.ndarray, of: np.ndarray, share: float, seed: int = 7) -> Machine:
    """Fit the machine on distinct (text, term) pairs sorted by text.

    Terms without a clear relation to the label (chi-squared) get no weights, which keeps
    chance words from adding up in long texts. Mini-batches with per-weight steps.
    """
    n = len(y)
    toxic = np.bincount(of, y[rows], BUCKETS)
    seen = np.bincount(of, minlength=BUCKETS).astype(float)
    rate = y.mean()
    expected = seen * rate
    spread = np.maximum(expected * (1 - rate) * (1 - seen / n), 1e-9)
    known = (seen >= LEAST_TEXTS) & ((toxic - expected) ** 2 / spread >= LEAST_CHI2)
    keep = known[of]
    rows, of = rows[keep], of[keep]
    at = np.searchsorted(rows, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, share / max(rate, 1e-9), (1 - share) / max(1 - rate, 1e-9))
    bias, bias_g = float(np.log(share / (1 - share))), 1e-8
    linear, linear_g = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    vectors = np.where(known[:, None], rng.normal(0, 0.02, (BUCKETS, FACTORS)), 0.0)
    vectors_g = np.full((BUCKETS, FACTORS), 1e-8)
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        for start in range(0, n, BATCH):
            batch = order[start:start + BATCH]
            size = at[batch + 1] - at[batch]
            local = np.repeat(np.arange(len(batch)), size)
            pick = of[np.repeat(at[batch] - np.cumsum(size) + size, size)
                      + np.arange(size.sum())]
            v = vectors[pick]
            sums = np.zeros((len(batch), FACTORS))
            np.add.at(sums, local, v)
            pair = 0.5 * ((sums ** 2).sum(1) - np.bincount(local, (v * v).sum(1), len(batch)))
            margin = bias + np.bincount(local, linear[pick], len(batch)) + pair
            slope = weight[batch] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[batch])
            step = slope.mean()
            bias_g += step * step
            bias -= RATE * step / np.sqrt(bias_g)
            used, place = np.unique(pick, return_inverse=True)
            g = np.bincount(place, slope[local]) / len(batch) + DECAY * linear[used]
            linear_g[used] += g * g
            linear[used] -= RATE * g / np.sqrt(linear_g[used])
            gv = np.zeros((len(used), FACTORS))
            np.add.at(gv, place, slope[local, None] * (sums[local] - v))
            gv = gv / len(batch) + DECAY * vectors[used]
            vectors_g[used] += gv * gv
            vectors[used] -= 0.2 * RATE * gv / np.sqrt(vectors_g[used])
    return Machine(bias, linear.astype(np.float32), vectors.astype(np.float32), known)


def constant(share: float) -> Machine:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Machine(float(np.log(share / (1 - share))), np.zeros(BUCKETS, np.float32),
                   np.zeros((BUCKETS, 1), np.float32), np.zeros(BUCKETS, bool))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS,
                 max_bytes: int = MAX_BYTES) -> Machine:
    """Learn from a sample of at most ``per_class`` labelled texts of each class.

    Terms are taken on the executors; the driver gets hashed terms of the sample only.
    """
    counts = {r["toxic"]: r["n"] for r in
              labels.where(F.col("toxic").isin(0, 1) & (remainder("doc_id", PARTS) != HELD_OUT))
              .groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    sample = labelled_sample(docs, labels, "toxic", PARTS, HELD_OUT, per_class, max_bytes)

    def features(batches):
        for batch in batches:
            for rows, texts in blocks(batch, "text"):
                row, of = distinct(*terms(texts))
                at = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.ListArray.from_arrays(
                        pa.array(at), pa.array(of.astype(np.int32)))], names=["_at", "y", "terms"])

    found = (sample.select("_at", "y", "text")
             .mapInArrow(features, "_at bigint, y int, terms array<int>")
             .orderBy("_at", "y").toArrow())
    y = found.column("y").to_numpy().astype(float)
    if not (0 < y.sum() < len(y)):
        return constant(share)
    lists = found.column("terms").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    size = np.diff(lists.offsets.to_numpy())
    rows = np.repeat(np.arange(len(y)), size)
    return train(y, rows, lists.flatten().to_numpy().astype(np.int64),
                 min(max(share, 0.001), 0.999))


def with_toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """All rows and columns, and ``_toxicity``, the score of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    schema = T.StructType(docs.schema.fields + [T.StructField("_toxicity", T.DoubleType())])

    def score(batches):
        machine = shared.value
        for batch in batches:
            for rows, texts in blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(machine.score(texts))],
                    names=[*rows.schema.names, "_toxicity"])

    return docs.mapInArrow(score, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = with_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, labels))
    return scored.select(
        "doc_id", F.coalesce(remainder("doc_id", PARTS) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col("_toxicity").alias("score"),
        (F.col("_toxicity") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score stays below the threshold, with their columns."""
    scored = with_toxicity(docs, fit_toxicity(docs, labels))
    return scored.where(F.col("_toxicity") < THRESHOLD).drop("_toxicity")
