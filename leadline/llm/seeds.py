"""Benchmark decontamination by spaced seeds.

Fixed masks of ``MASKS`` pick six of a run of words and ignore the others; the hashes of
the picked words of test items and documents are matched. Around each hit the words of both
are compared place by place: an item is found where, among ``WINDOW`` words in a row, at
least ``NEEDED`` are equal. Every two substitutions among 13 words leave a hit of a mask.

Items with fewer words than the window are found only whole and unchanged, by a mask of their
length; items with fewer than ``LEAST`` words are too common to be searched.

Items are the stated query set: they are taken in blocks of at most ``BLOCK_MB`` of text, each
block meets all documents, and a block is all that is broadcast.

Defined cases: null and empty texts and items hold no words and are never found; a repeated
document gives its rows again; a repeated item counts once, other texts of one item_id are
items of their own. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline.llm.text import BASE, blocks, hashes, mix, words

WINDOW, NEEDED, LEAST = 13, 11, 5
MASKS = ("11101011", "11001111")
BLOCK_MB = 16
BITS = 22


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, starts, ends, first = words(texts)
    return hashes(data, starts, ends), first


def picked(each: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the picked words at every place; places may reach over a text's end."""
    count = max(0, len(each) - len(mask) + 1)
    value = np.full(count, hash_of(mask), np.uint64)
    for k, one in enumerate(mask):
        if one == "1":
            value = value * np.uint64(BASE) + each[k:k + count]
    return mix(value)


def hash_of(mask: str) -> np.uint64:
    return np.uint64(int(mask, 2) * 64 + len(mask))


@dataclass
class Items:
    """Word hashes of a block of items, and the sorted seeds that lead to them."""

    ids: list
    lines: list[np.ndarray]
    seeds: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: list, texts: list[str]) -> Items:
        each, first = word_hashes(pa.array(texts, pa.large_string()))
        lines = [each[a:b] for a, b in zip(first[:-1], first[1:])]
        found: dict[str, list[tuple[np.ndarray, int, np.ndarray]]] = {}
        for k, line in enumerate(lines):
            if len(line) < LEAST:
                continue
            for mask in MASKS if len(line) >= WINDOW else ("1" * len(line),):
                value = picked(line, mask)
                found.setdefault(mask, []).append((value, k, np.arange(len(value))))
        seeds = {}
        for mask, parts in found.items():
            value = np.concatenate([p[0] for p in parts])
            item = np.concatenate([np.full(len(p[0]), p[1]) for p in parts])
            place = np.concatenate([p[2] for p in parts])
            order = np.argsort(value, kind="stable")
            sieve = np.zeros(1 << BITS, bool)
            sieve[value & np.uint64((1 << BITS) - 1)] = True
            seeds[mask] = value[order], item[order], place[order], sieve
        return cls(ids, lines, seeds)

    def hits(self, each: np.ndarray, first: np.ndarray) -> set[tuple[int, int, int]]:
        """Text, item, and the place in the text where the item would begin."""
        found = set()
        for mask, (table, item, place, sieve) in self.seeds.items():
            value = picked(each, mask)
            at = np.flatnonzero(sieve[value & np.uint64((1 << BITS) - 1)])
            low = np.searchsorted(table, value[at], "left")
            high = np.searchsorted(table, value[at], "right")
            text = np.searchsorted(first, at, "right") - 1
            inside = (high > low) & (at + len(mask) <= first[text + 1])
            for a, t, lo, hi in zip(at[inside], text[inside], low[inside], high[inside]):
                for k in range(lo, hi):
                    found.add((int(t), int(item[k]), int(a - first[t] - place[k])))
        return found

    def overlap(self, line: np.ndarray, item: int, shift: int) -> tuple[int, int, int] | None:
        """Start in the text, words and equal words of the overlap on one diagonal, if enough."""
        own = self.lines[item]
        low, high = max(0, -shift), min(len(own), len(line) - shift)
        window = min(WINDOW, len(own))
        needed = NEEDED if window == WINDOW else window
        if high - low < window:
            return None
        sums = np.append(0, np.cumsum(own[low:high] == line[low + shift:high + shift]))
        good = np.flatnonzero(sums[window:] - sums[:-window] >= needed)
        if not len(good):
            return None
        start, stop = int(good[0]), int(good[-1]) + window
        return low + shift + start, stop - start, int(sums[stop] - sums[start])

    def search(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """Text, item, start, words and equal words; the best overlap of each pair."""
        each, first = word_hashes(texts)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for t, item, shift in self.hits(each, first):
            seen = self.overlap(each[first[t]:first[t + 1]], item, shift)
            if seen:
                rank = (-seen[2], seen[0], seen[1])
                best[t, item] = min(best.get((t, item), rank), rank)
        return [(t, item, start, n, -same) for (t, item), (same, start, n) in sorted(best.items())]


def item_blocks(benchmark: DataFrame) -> list[Items]:
    """The items in blocks of bounded size."""
    own = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // (BLOCK_MB << 20) + 1
    for k in range(parts):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy(
            "item_id", "text")
        found = rows.toArrow()  # one block
        yield Items.of(found.column("item_id").to_pylist(), found.column("text").to_pylist())


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, words, equal_words for every document that holds an item."""
    schema = T.StructType([
        docs.schema["doc_id"], benchmark.schema["item_id"],
        *(T.StructField(n, T.LongType()) for n in ("start_word", "words", "equal_words"))])
    found = None
    for items in item_blocks(benchmark):
        part = _searched(docs, items, schema)
        found = part if found is None else found.unionByName(part)
    return found


def _searched(docs: DataFrame, items: Items, schema: T.StructType) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def search(batches):
        own = shared.value
        for batch in batches:
            for rows, texts in blocks(batch, "text"):
                seen = own.search(texts)
                columns = list(zip(*seen)) if seen else [[]] * 5
                ids = pa.array([own.ids[k] for k in columns[1]], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(columns[0], pa.int64())), ids,
                     *(pa.array(c, pa.int64()) for c in columns[2:])],
                    names=schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(search, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with their columns."""
    for items in item_blocks(benchmark):
        docs = _without(docs, items)
    return docs


def _without(docs: DataFrame, items: Items) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def search(batches):
        own = shared.value
        for batch in batches:
            for rows, texts in blocks(batch, "text"):
                clean = np.ones(len(texts), bool)
                clean[[seen[0] for seen in own.search(texts)]] = False
                yield rows.filter(pa.array(clean))

    return docs.mapInArrow(search, docs.schema)
