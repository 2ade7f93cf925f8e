"""Packing of documents into windows by non-negative least squares on the length histogram.

Every document becomes its token ids and one closing id. Whole windows are cut off its
front; what remains is a piece of some length. Lengths are rounded up to units of ``UNIT``
tokens and counted. All combinations of up to three lengths that fill a window exactly are
the columns of a least-squares problem with non-negative repeat counts; the rounded counts
use up most pieces, and a greedy pass over the counts that are left packs the rest. All of
this works on counts, so its size does not depend on the number of documents. Pieces then
find their window by their rank among the pieces of equal length.

Defined cases: null and empty texts are one piece that holds the closing id. Repeated rows
are packed once each; columns other than doc_id and text are ignored. An empty table gives
no rows.
"""

from __future__ import annotations

import os
import zlib
from functools import cache
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadline.llm.pretokens import unusual, word_level
from leadline.llm.text import blocks, buffers, slices
from leadline.session import materialise

WINDOW, UNIT, CLOSING_ID = 2048, 4, 1
KEPT = 400_000
GROUPING = 4   # a length's pieces are ranked in sqrt(rows) / GROUPING groups


class Encoder:
    """Token ids of texts; ids of pieces are kept, up to ``KEPT`` pieces per worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.known) > KEPT:
            self.known.clear()
        new = [p for p in pieces if p not in self.known]
        for start in range(0, len(new), 4096):
            part = new[start:start + 4096]
            coded = self.tokenizer.encode_batch_fast([p.decode() for p in part],
                                                     add_special_tokens=False)
            self.known.update((p, np.array(c.ids, "<u4").tobytes()) for p, c in zip(part, coded))
        return [self.known[p] for p in pieces]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids start and end."""
        odd = unusual(texts)
        data, bounds = buffers(pc.utf8_lower(texts))
        starts, ends = word_level(data, bounds)
        flat, at = np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        if len(starts):
            coded = slices(data, starts, ends).dictionary_encode()
            ids = self.ids_of(coded.dictionary.to_pylist())
            size = np.array([len(i) // 4 for i in ids], np.int64)
            first = np.cumsum(size) - size
            table, of = np.frombuffer(b"".join(ids), "<u4"), coded.indices.to_numpy()
            n = size[of]
            done = np.cumsum(n)
            flat = table[np.repeat(first[of] - done + n, n) + np.arange(done[-1])]
            at = np.concatenate([[0], done])[np.searchsorted(starts, bounds)]
        if odd.any():  # these go through the library as they are
            parts = [flat[at[k]:at[k + 1]] for k in range(len(texts))]
            for k in np.flatnonzero(odd):
                parts[k] = np.array(self.tokenizer.encode(
                    texts[int(k)].as_py(), add_special_tokens=False).ids, "<u4")
            flat = np.concatenate(parts)
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return flat, at


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(docs: DataFrame, path: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""

    def pieces(batches):
        tokens = encoder(path)
        closing = np.array([CLOSING_ID], "<u4").tobytes()
        for batch in batches:
            for rows, texts in blocks(batch, "text"):
                flat, at = tokens.encode(texts)
                n = np.diff(at) + 1
                parts = -(-n // WINDOW)
                row = np.repeat(np.arange(len(n)), parts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * WINDOW
                length = np.minimum(WINDOW, n[row] - start)
                raw = flat.tobytes()
                crc = []
                for a, s, m, whole in zip(at[row].tolist(), start.tolist(), length.tolist(),
                                          n[row].tolist()):
                    last = s + m == whole
                    part = raw[4 * (a + s):4 * (a + s + m - last)]
                    crc.append(zlib.crc32(closing, zlib.crc32(part)) if last
                               else zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(row)), pa.array(start), pa.array(length),
                     pa.array(crc, pa.int64()), pa.array(n[row])],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        pieces, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def combinations(units: int) -> np.ndarray:
    """Up to three lengths that fill ``units`` exactly, longest first, 0 where there is none."""
    found = [(units, 0, 0)]
    for a in range(units - 1, 0, -1):
        for b in range(min(a, units - a), 0, -1):
            c = units - a - b
            if c <= b:
                found.append((a, b, c))
    return np.array(found, np.int64)


def least_squares(columns: np.ndarray, counts: np.ndarray, steps: int = 3000) -> np.ndarray:
    """Non-negative repeat counts x that bring the used lengths near ``counts``.

    Accelerated projected gradient. Using more pieces of a length than there are is as bad
    as leaving some; long pieces weigh more, since they are the harder ones to place later.
    """
    units = len(counts) - 1
    weight = np.sqrt(np.arange(units + 1) / units)
    weight[0] = 0.0
    scale = max(1.0, counts.max())
    goal = counts / scale * weight

    def used(x):
        return weight * sum(np.bincount(columns[:, k], x, units + 1) for k in range(3))

    # a bound of the largest eigenvalue by power iteration
    v = np.ones(len(columns))
    for _ in range(30):
        w = weight * used(v)
        v = sum(w[columns[:, k]] for k in range(3))
        top = np.linalg.norm(v)
        v = v / max(top, 1e-12)
    x = np.zeros(len(columns))
    ahead, speed = x, 1.0
    for _ in range(steps):
        slope = weight * (used(ahead) - goal)
        after = np.maximum(ahead - sum(slope[columns[:, k]] for k in range(3)) / (1.05 * top), 0)
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead = after + (speed - 1) / faster * (after - x)
        x, speed = after, faster
    return x * scale


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in units, how many windows) so that every counted piece has its place."""
    units, left, made = len(counts) - 1, counts.astype(np.int64).copy(), []

    def use(lengths: tuple[int, ...], times: int) -> None:
        for k in lengths:
            left[k] -= times
        made.append((lengths, times))

    if left[units]:
        use((units,), int(left[units]))
    if left.sum():
        columns = combinations(units)[1:]
        wanted = least_squares(columns, left.astype(float))
        for at in np.argsort(-wanted, kind="stable"):
            times = int(np.floor(wanted[at] + 0.5))
            if times <= 0:
                break
            lengths = tuple(int(k) for k in columns[at] if k)
            times = min([times, *(int(left[k]) // lengths.count(k) for k in set(lengths))])
            if times > 0:
                use(lengths, times)
    while left.any():  # the longest first, then always the longest that fits
        gap, lengths, taken = units, [], np.zeros_like(left)
        while True:
            fits = np.flatnonzero(left[:gap + 1] > taken[:gap + 1])
            if not len(fits):
                break
            longest = int(fits[-1])
            lengths.append(longest)
            taken[longest] += 1
            gap -= longest
        use(tuple(lengths), min(int(left[k] // taken[k]) for k in set(lengths)))
    return made


def places(made: list[tuple[tuple[int, ...], int]], units: int) -> dict[int, np.ndarray]:
    """For each length: rank from which a window list begins, its first id, place inside."""
    found: dict[int, list[tuple[int, int, int]]] = {k: [] for k in range(units + 1)}
    taken, first = [0] * (units + 1), 0
    for lengths, times in made:
        for slot, k in enumerate(lengths):
            found[k].append((taken[k], first, slot))
            taken[k] += times
        first += times
    return {k: np.array(v, np.int64) for k, v in found.items() if v}


def pack(docs: DataFrame, path: str) -> DataFrame:
    """Pieces with their window (sequence_id) and place in it (offset)."""
    units = WINDOW // UNIT
    stored = materialise(cut(docs, path)
                         .withColumn("_units", F.ceil(F.col("length") / UNIT).cast("int"))
                         .withColumn("_row", F.monotonically_increasing_id()))
    # one length may hold any share of the rows: the number and the size of the groups ranked
    # together both grow with the root of the rows
    groups = max(1, isqrt(stored.count()) // GROUPING)
    split = stored.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    sizes = materialise(split.groupBy("_units", "_group").agg(F.count(F.lit(1)).alias("_n")))
    counts = np.zeros(units + 1, np.int64)
    for r in sizes.groupBy("_units").agg(F.sum("_n").alias("n")).collect():
        counts[r["_units"]] = r["n"]
    shared = docs.sparkSession.sparkContext.broadcast(places(plan(counts), units))
    before = Window.partitionBy("_units").orderBy("_group")
    sizes = sizes.withColumn("_before", F.sum("_n").over(before) - F.col("_n")).drop("_n")
    ranked = split.withColumn("_rank", F.row_number().over(
        Window.partitionBy("_units", "_group").orderBy("_row")))
    ranked = ranked.join(sizes, ["_units", "_group"]).withColumn(
        "_rank", F.col("_rank") - 1 + F.col("_before"))

    def place(batches):
        table = shared.value
        for batch in batches:
            unit = batch.column(0).to_numpy()
            rank = batch.column(1).to_numpy()
            window, slot = np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64)
            for k in np.unique(unit):
                of = np.flatnonzero(unit == k)
                at = np.searchsorted(table[k][:, 0], rank[of], "right") - 1
                window[of] = table[k][at, 1] + rank[of] - table[k][at, 0]
                slot[of] = table[k][at, 2]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], pa.array(window), pa.array(slot)],
                names=[*batch.schema.names[2:], "sequence_id", "_slot"])

    kind = dict(docs.dtypes)["doc_id"]
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = ranked.select("_units", "_rank", *kept).mapInArrow(
        place, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, "
               "doc_tokens bigint, sequence_id bigint, _slot bigint")
    inside = Window.partitionBy("sequence_id").orderBy("_slot")
    return placed.withColumn("offset", F.sum("length").over(inside) - F.col("length")).select(
        *kept, "sequence_id", "offset")
