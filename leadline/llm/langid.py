"""Language of a text from known words first, and shorter and shorter grams for the rest.

A word that was seen in training scores by its log frequency in each language. Any other
word scores by its longest character grams that were seen in training: those of four
characters, else three, two, one. The scores of the words add up.

Defined cases: a null text and a text without a letter are ``und`` with score 0, as is every
text when there is nothing to learn from; ties go to the language that sorts first. One row
out for each row in, whatever repeats.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadline.llm.sampling import remainder
from leadline.llm.text import BASE, blocks, buffers, hashes, mix, slices, words

PARTS, HELD_OUT = 5, 0
PER_LANGUAGE = 4000            # documents of each language learnt from
BLOCK = 1 << 19                # bytes of text whose words are looked up at a time
WORDS, GRAMS = 40_000, 20_000  # most frequent ones kept for each language and order
ORDERS = (4, 3, 2, 1)
UNDETERMINED = "und"


def vocabulary(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words of a block, the word at each place, first place of each text."""
    data, starts, ends, first = words(texts, numbers=False)
    if not len(starts):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), first
    coded = slices(data, starts, ends).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), first


def word_keys(distinct: pa.Array) -> np.ndarray:
    data, bounds = buffers(distinct)
    return hashes(data, bounds[:-1], bounds[1:])


def grams(distinct: pa.Array, order: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``chosen``, key) of every gram of the chosen words.

    A blank stands before and after a word; grams of one character are its letters only.
    """
    texts = distinct.take(pa.array(chosen)).cast(pa.large_string()).to_pylist()
    line = np.frombuffer(f" {' '.join(texts)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size + 1) - size
    if order > 1:
        start, size = start - 1, size + 2
    n = np.maximum(size - order + 1, 0)
    of = np.repeat(np.arange(len(texts)), n)
    at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
    key = np.full(len(at), np.uint64(order))
    for k in range(order):
        key = key * np.uint64(BASE) + line[at + k]
    return of, mix(key)


@dataclass
class LanguageModel:
    """Languages, and for words (order 0) and each gram order sorted keys with log shares."""

    languages: list[str]
    tables: dict[int, tuple[np.ndarray, np.ndarray]]

    def look_up(self, order: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table, shares = self.tables[order]
        if not len(table):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return table[at] == keys, at

    def of_words(self, distinct: pa.Array) -> np.ndarray:
        """Log scores of words, a row for each word and a column for each language."""
        n = len(distinct)
        found = np.zeros((n, len(self.languages)))
        known, at = self.look_up(0, word_keys(distinct))
        found[known] = self.tables[0][1][at[known]]
        rest = np.flatnonzero(~known)
        for order in ORDERS:
            if not len(rest):
                break
            of, keys = grams(distinct, order, rest)
            known, at = self.look_up(order, keys)
            seen = np.bincount(of[known], minlength=len(rest))
            for k in range(len(self.languages)):
                share = np.bincount(of[known], self.tables[order][1][at[known], k], len(rest))
                found[rest, k] = np.where(seen > 0, share / np.maximum(seen, 1), found[rest, k])
            rest = rest[seen == 0]
        return found

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        distinct, at, first = vocabulary(texts)
        if not self.languages or not len(distinct):
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        each = self.of_words(distinct)
        of = np.repeat(np.arange(len(texts)), np.diff(first))
        total = np.stack([np.bincount(of, each[at, k], len(texts))
                          for k in range(each.shape[1])], axis=1)
        best = total.argmax(1)
        share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        empty = first[1:] == first[:-1]
        names = [UNDETERMINED if e else self.languages[b] for b, e in zip(best, empty)]
        return names, np.where(empty, 0.0, share)


def fit_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from at most ``per_language`` documents of each language, chosen by a hash."""
    marked = (docs.where(F.col("lang").isNotNull() & (F.col("lang") != UNDETERMINED)
                         & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                         & (remainder("doc_id", PARTS) != HELD_OUT))
              .select("doc_id", "lang", F.xxhash64("doc_id").alias("_at")))
    order = Window.partitionBy("lang").orderBy("_at", "doc_id")
    chosen = marked.withColumn("_n", F.row_number().over(order)).where(
        F.col("_n") <= per_language).select("doc_id", "lang").distinct()
    # the right side holds per_language ids of each language at most
    sample = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])

    def count(batches):
        for batch in batches:
            for rows, texts in blocks(batch, "text", BLOCK):
                names = rows.column(0).to_pylist()
                for name in sorted(set(names)):
                    own = texts.filter(pa.array([n == name for n in names]))
                    distinct, at, _ = vocabulary(own)
                    if not len(distinct):
                        continue
                    n = np.bincount(at, minlength=len(distinct)).astype(np.int64)
                    parts = [(0, word_keys(distinct), n)]
                    for size in ORDERS:
                        of, keys = grams(distinct, size, np.arange(len(distinct)))
                        keys, place = np.unique(keys, return_inverse=True)
                        parts.append((size, keys, np.bincount(place, n[of]).astype(np.int64)))
                    for size, keys, n in parts:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(keys), pa.string()),
                             pa.array(np.full(len(keys), size, np.int32)),
                             pa.array(keys.view(np.int64)), pa.array(n)],
                            names=["lang", "size", "key", "n"])

    counted = sample.select("lang", "text").mapInArrow(
        count, "lang string, size int, key bigint, n bigint").groupBy("lang", "size", "key").agg(
        F.sum("n").alias("n"))
    best = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "key")
    kept = (counted.withColumn("_r", F.row_number().over(best))
            .where(F.col("_r") <= F.when(F.col("size") == 0, WORDS).otherwise(GRAMS))
            .where((F.col("size") > 0) | (F.col("n") > 1)).drop("_r").toArrow())
    lang = np.array(kept.column("lang").to_pylist(), object)
    size, n = kept.column("size").to_numpy(), kept.column("n").to_numpy()
    key = kept.column("key").to_numpy().view(np.uint64)
    languages = sorted(set(lang))
    tables = {}
    for s in (0, *ORDERS):
        of = size == s
        keys, place = np.unique(key[of], return_inverse=True)
        counts = np.zeros((len(keys), len(languages)))
        which = np.searchsorted(np.array(languages, object), lang[of]) if languages else []
        counts[place, which] = n[of]
        tables[s] = keys, np.log((counts + 0.5) / (counts.sum(0) + 0.5 * max(1, len(keys))))
    return LanguageModel(languages, tables)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_languages(docs))

    def predict(batches):
        model = shared.value
        for batch in batches:
            for rows, texts in blocks(batch, "text", BLOCK):
                names, score = model.predict(texts)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(names, pa.string()), pa.array(score)],
                    names=["doc_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    found = docs.select("doc_id", "text").mapInArrow(
        predict, f"doc_id {kind}, lang_pred string, score double")
    return found.select(
        "doc_id", F.coalesce(remainder("doc_id", PARTS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "lang_pred", "score")
