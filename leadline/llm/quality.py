"""Quality from compression: which labelled corpus explains a text better.

Two Zstandard dictionaries are trained, one on good and one on bad labelled texts. A text is
compressed with each; the difference of the sizes over the size of the text is its evidence,
and an isotonic fit on other labelled texts turns evidence into a probability.

Defined cases: a null or empty text has no evidence (0) and gets the probability of that;
without labels of both classes every text scores the share of good labels, 0.5 if there is
none. Repeated rows and extra columns do not matter: one row out for each row in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadline.llm.sampling import labelled_sample, remainder
from leadline.llm.text import blocks

PARTS, HELD_OUT = 4, 2
PER_CLASS = 2400       # labelled texts of each class learnt from, half of them to calibrate
MAX_BYTES = 32_768     # longer labelled texts are not learnt from
DICTIONARY_BYTES = 112_640
LEVEL = 3
DAMP = 20              # added to the size of a text, so that very short texts say little
THRESHOLD = 0.7


@dataclass
class QualityModel:
    """Dictionaries and the calibration curve; empty dictionaries mean a constant score."""

    good: bytes
    bad: bytes
    evidence: np.ndarray
    probability: np.ndarray

    def compressors(self):
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d),
                                         write_content_size=False, write_dict_id=False)
                for d in (self.good, self.bad)]

    def differences(self, texts: list[bytes]) -> np.ndarray:
        if not self.good:
            return np.zeros(len(texts))
        good, bad = self.compressors()
        return np.array([(len(bad.compress(t)) - len(good.compress(t))) / (len(t) + DAMP)
                         if t else 0.0 for t in texts], float)

    def score(self, differences: np.ndarray) -> np.ndarray:
        return np.interp(differences, self.evidence, self.probability)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising curve that fits y best: pooled neighbours, at their mean x."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x[order], y[order], weight[order]):
        pools.append([xi * wi, yi * wi, wi])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    table = np.array(pools)
    # one good and one bad text of doubt in each pool keep the ends off 0 and 1
    doubt = weight.mean()
    return table[:, 0] / table[:, 2], (table[:, 1] + doubt) / (table[:, 2] + 2 * doubt)


def _rising(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strictly rising knots with wide ends, so that ranks survive the calibration."""
    p = np.maximum.accumulate(p)
    p = p + 1e-6 * np.arange(len(p))
    x = np.concatenate([[x[0] - 1.0], x, [x[-1] + 1.0]])
    p = np.concatenate([[p[0] * 0.5], p, [1 - (1 - min(p[-1], 1.0)) * 0.5]])
    return x, np.clip(p, 0.0, 1.0)


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS,
                max_bytes: int = MAX_BYTES) -> QualityModel:
    """Learn from a sample of at most ``per_class`` labelled texts of each class."""
    counts = {r["quality"]: r["n"] for r in
              labels.where(F.col("quality").isin(0, 1) & (remainder("doc_id", PARTS) != HELD_OUT))
              .groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    rows = labelled_sample(docs, labels, "quality", PARTS, HELD_OUT, per_class,
                           max_bytes).orderBy("_at", "doc_id").collect()
    side = {y: [r["text"].encode("utf-8", "replace") for r in rows if r["y"] == y and r["text"]]
            for y in (0, 1)}
    flat = QualityModel(b"", b"", np.array([0.0]), np.array([share]))
    if min(map(len, side.values())) < 16:
        return flat
    try:
        made = [zstandard.train_dictionary(DICTIONARY_BYTES, side[y][::2]).as_bytes()
                for y in (1, 0)]
    except zstandard.ZstdError:  # too little text for a dictionary of that size
        made = [zstandard.ZstdCompressionDict(
            b"\n".join(side[y][::2])[-DICTIONARY_BYTES:]).as_bytes() for y in (1, 0)]
    model = QualityModel(*made, flat.evidence, flat.probability)
    others = {y: model.differences(side[y][1::2]) for y in (0, 1)}
    x = np.concatenate([others[0], others[1]])
    y = np.repeat([0.0, 1.0], [len(others[0]), len(others[1])])
    weight = np.where(y == 1, share / len(others[1]), (1 - share) / len(others[0])) * len(x)
    model.evidence, model.probability = _rising(*isotonic(x, y, weight))
    return model


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, difference, score of every row, from its whole text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        model = shared.value
        for batch in batches:
            for rows, texts in blocks(batch, "text"):
                found = model.differences(texts.cast("large_binary").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(found), pa.array(model.score(found))],
                    names=["doc_id", "difference", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        score, f"doc_id {kind}, difference double, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (and the difference) of every document."""
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.select(
        "doc_id", F.coalesce(remainder("doc_id", PARTS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "difference")
