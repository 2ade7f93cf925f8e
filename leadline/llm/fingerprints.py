"""Fingerprints of texts from improbable byte windows in chained Bloom filters.

Every run of 64 bytes has an entropy, quantised to ``LEVELS`` levels. Levels that are rare
among the consecutive 64-byte runs of all documents rank first. Each run of 64 neighbouring
windows votes for its best ranked one, the leftmost of equals; windows with ``VOTES`` votes
are features. Features go into Bloom filters of 2048 bits by five 11-bit parts of a hash, 160
to a filter, then a new filter is chained. Two fingerprints are alike by the mean over the
filters of the shorter one of the best normalised overlap of bits.

Texts with fewer than 64 bytes are one feature. Equal texts have equal fingerprints whatever
else their block holds; fingerprints of one call of ``fingerprints`` share one ranking.

Defined cases: a null text counts as empty; the fingerprint of an empty text is the empty
string, alike (1) to itself only. Documents of one doc_id are ordered by a hash of the text; a
null doc_id comes last. A single document is its own next one. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadline.llm.text import blocks, buffers, filled, hashes

WIDTH, LEVELS, VOTES = 64, 1000, 16
BITS, PARTS, PER_FILTER = 2048, 5, 160
CUTOFF = 0.3           # share of the possible overlap beyond chance that counts as none
ROWS_PER_PART, MOST_PARTS = 4000, 2048
_counts = np.arange(1, WIDTH + 2, dtype=float)
WEIGHT = np.append(0, np.round(_counts * np.log2(_counts) * (1 << 20))).astype(np.int64)
MOST = int(WEIGHT[WIDTH])
FAR = np.int64(1) << np.int64(62)


def level(weights: np.ndarray) -> np.ndarray:
    """The quantised entropy of windows with the given sum of c * log2(c)."""
    return (MOST - weights) * LEVELS // MOST


def window_levels(data: np.ndarray) -> np.ndarray:
    """The level of the window that starts at each byte, as far as windows fit."""
    n = len(data)
    if n < WIDTH:
        return np.zeros(0, np.int64)
    order = np.argsort(data, kind="stable")
    key = data[order].astype(np.int64) * (n + 2 * WIDTH) + WIDTH + order
    at = np.arange(n)
    ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)
    # equal bytes in the window that starts here, and in the 63 bytes before
    ahead[order] = np.searchsorted(key, key + WIDTH) - at
    behind[order] = at - np.searchsorted(key, key - (WIDTH - 1))
    start = int(WEIGHT[np.bincount(data[:WIDTH], minlength=256)].sum())
    out, into = ahead[:n - WIDTH], behind[WIDTH:]
    step = WEIGHT[out - 1] - WEIGHT[out] + WEIGHT[into + 1] - WEIGHT[into]
    return level(np.append(start, start + np.cumsum(step)))


def block_levels(texts: pa.Array) -> np.ndarray:
    """How often each level occurs among the consecutive windows of each text."""
    data, bounds = buffers(texts)
    seen = np.zeros(LEVELS + 1, np.int64)
    for a, b in zip(bounds[:-1], bounds[1:]):
        rows = data[a:a + (b - a) // WIDTH * WIDTH].reshape(-1, WIDTH)
        if not len(rows):
            continue
        place = rows.astype(np.int64) + 256 * np.arange(len(rows))[:, None]
        count = np.bincount(place.ravel(), minlength=256 * len(rows)).reshape(-1, 256)
        seen += np.bincount(level(WEIGHT[count].sum(1)), minlength=LEVELS + 1)
    return seen


def ranking(seen: np.ndarray) -> np.ndarray:
    """The rank of each level, the rarest first; equally rare ones by higher entropy."""
    order = np.lexsort((-np.arange(LEVELS + 1), seen))
    rank = np.empty(LEVELS + 1, np.int64)
    rank[order] = np.arange(LEVELS + 1)
    return rank


def features(texts: pa.Array, rank: np.ndarray) -> list[np.ndarray]:
    """The distinct feature hashes of each text in the order of their first place."""
    data, bounds = buffers(texts)
    levels = window_levels(data)
    key = rank[levels] << 32 | np.arange(len(levels))
    best = key
    for step in (1, 2, 4, 8, 16, 32):
        best = np.minimum(best[:-step], best[step:]) if len(best) > step else best[:0]
    found = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        windows = b - a - WIDTH + 1
        if b == a:
            found.append(np.zeros(0, np.uint64))
            continue
        if windows < 1:
            at, ends = np.array([a]), np.array([b])
        else:
            if windows < WIDTH:
                at = key[a:a + windows].min(keepdims=True) & 0xFFFFFFFF
            else:
                voted, votes = np.unique(best[a:a + windows - WIDTH + 1] & 0xFFFFFFFF,
                                         return_counts=True)
                at = voted[votes >= min(VOTES, votes.max())]
            ends = at + WIDTH
        # running sums are taken over this text only
        own = hashes(data[a:b], at - a, ends - a)
        _, first = np.unique(own, return_index=True)
        found.append(own[np.sort(first)])
    return found


def chained(own: np.ndarray) -> np.ndarray:
    """Bloom filters as rows of bytes."""
    count = -(-len(own) // PER_FILTER)
    bits = np.zeros((count, BITS), bool)
    row = np.arange(len(own)) // PER_FILTER
    for k in range(PARTS):
        bits[row, (own >> np.uint64(11 * k) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """0 to 1: the mean best overlap of the filters of the shorter chain."""
    if one.shape == other.shape and (one == other).all():
        return 1.0
    if not len(one) or not len(other):
        return 0.0
    if len(one) > len(other):
        one, other = other, one
    size = np.bitwise_count(other).sum(1).astype(float)
    total = 0.0
    for line in one:
        own = float(np.bitwise_count(line).sum())
        both = np.bitwise_count(line & other).sum(1)
        most, chance = np.minimum(own, size), own * size / BITS
        floor = chance + CUTOFF * (most - chance)
        total += float(np.clip((both - floor) / np.maximum(most - floor, 1e-9), 0, 1).max())
    return total / len(one)


def digests(texts: pa.Array, rank: np.ndarray) -> list[np.ndarray]:
    found = []
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    for _, part in blocks(batch, "text"):
        found += [chained(own) for own in features(part, rank)]
    return found


def written(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def corpus_ranking(docs: DataFrame) -> np.ndarray:
    """Ranks of the levels from all documents."""

    def count(batches):
        seen = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            for _, texts in blocks(batch, "text"):
                seen += block_levels(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS + 1)), pa.array(seen)],
                                         names=["level", "n"])

    rows = docs.select("text").mapInArrow(count, "level bigint, n bigint").groupBy(
        "level").agg(F.sum("n").alias("n")).collect()  # one row for each level
    seen = np.zeros(LEVELS + 1, np.int64)
    for row in rows:
        seen[row["level"]] = row["n"]
    return ranking(seen)


def in_order(docs: DataFrame) -> DataFrame:
    """Rows in parts of descending doc_id; each part ends with the first row of the next one.

    Columns _part, _ghost (that extra row), doc_id, text; partitions hold whole parts, sorted.
    The last part is followed by the first one.
    """
    rows = docs.count()
    parts = min(rows // ROWS_PER_PART + 1, MOST_PARTS)
    cuts = docs.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.25 / parts
                               ) if parts > 1 else []
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(
        F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("doc_id")))
        if cuts else F.lit(0))
    # one row for each part
    firsts = sorted((r["_part"], r["first"]) for r in docs.groupBy(part.alias("_part")).agg(
        F.max("doc_id").alias("first")).collect())
    if not firsts:
        return docs.select(F.lit(0).alias("_part"), F.lit(False).alias("_ghost"), "doc_id", "text")
    before = [firsts[k - 1][0] for k in range(len(firsts))]
    ends = docs.sparkSession.createDataFrame(
        [(p, first, to) for (p, first), to in zip(firsts, before)],
        "_part int, _first bigint, _to int")
    place = F.struct(F.col("_part").alias("p"), F.lit(False).alias("g"))
    ghost = F.struct(F.col("_to").alias("p"), F.lit(True).alias("g"))
    dealt = (docs.select("doc_id", "text", part.alias("_part")).join(F.broadcast(ends), "_part")
             .withColumn("_at", F.explode(F.when(
                 F.col("doc_id").eqNullSafe(F.col("_first")), F.array(place, ghost))
                 .otherwise(F.array(place))))
             .select(F.col("_at.p").alias("_part"), F.col("_at.g").alias("_ghost"),
                     "doc_id", "text"))
    return dealt.repartition(len(firsts), "_part").sortWithinPartitions(
        "_part", "_ghost", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")


def edited(text: str, other: str) -> str:
    """The last third of the text replaced by as much of the start of the other one."""
    n = len(text) // 3
    return text[:len(text) - n] + other[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and both likenesses of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(corpus_ranking(docs))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
             "near_edited", "near_next"]

    def digest(batches):
        rank, last = shared.value, None
        for batch in batches:
            for rows, _ in blocks(batch, "text"):
                part, ghost, ids, _ = (rows.column(k).to_pylist() for k in range(4))
                texts = filled(rows.column(3))
                lines = list(zip(part, ghost, ids, texts.to_pylist(), digests(texts, rank)))
                if last is not None:
                    lines.insert(0, last)
                last = lines[-1]
                pairs = [(a, b) for a, b in zip(lines, lines[1:]) if a[0] == b[0] and not a[1]]
                changed = [edited(a[3], b[3]) for a, b in pairs]
                new = digests(pa.array(changed, pa.large_string()), rank)
                columns = [
                    pa.array([a[2] for a, _ in pairs], rows.column(2).type),
                    pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                    pa.array([written(a[4]) for a, _ in pairs], pa.string()),
                    pa.array([written(f) for f in new], pa.string()),
                    pa.array([likeness(a[4], f) for (a, _), f in zip(pairs, new)], pa.float64()),
                    pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(docs.dtypes)["doc_id"]
    return in_order(docs.select("doc_id", "text")).mapInArrow(
        digest, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
                "edited_fingerprint string, near_edited double, near_next double")
