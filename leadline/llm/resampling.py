"""Importance resampling towards a target distribution by hashed n-grams.

An untrained Regex Split of the tokenizers library takes the words of the ASCII-lowered text,
with their byte offsets. Windows of consecutive offset pairs are the features: runs of one to
``RUNS`` words. A feature counts in the bucket that its crc32 names. The log ratio of the
smoothed bucket shares in the target and in the corpus is a bucket's gain, a document weighs
the mean gain of its features, and noise from a hash of the id (Gumbel's) turns the highest
scores into a draw in proportion to the weights.

Words are taken once: a stored table holds the bucket counts of every document, from which the
histogram and then the weights are summed. Gains, one number for each bucket, are the only
thing that is broadcast. The draw is ranked by ranges of the score, not in one task.

Defined cases: null and wordless texts have no features and weight 0. A null id is hashed as
the empty string and comes last among ties; repeated rows are scored each and ranked one after
the other. With an empty target every count in it is 0. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import PreTokenizedString, Regex, pre_tokenizers

from leadline.llm.text import blocks
from leadline.session import materialise

RUNS, BUCKETS, SEED = 1, 10_000, 2024
LEAST_WORDS, PERCENT = 20, 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS = bytes(c for c in range(0x80) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A))
PIECE_BYTES = 1 << 18       # longer texts are split between words
RANKED_ROWS = 200_000       # rows of a range in the ranking
INSIDE = (1 << 33) - 1      # Spark numbers the rows of a partition in the lower 33 bits


@cache
def splitter() -> pre_tokenizers.PreTokenizer:
    return pre_tokenizers.Split(Regex(WORD), "removed", invert=True)


def words(piece: bytes) -> list[bytes]:
    """The words of a lower-case piece, cut out by the offsets of the Split."""
    line = PreTokenizedString(piece.decode())
    splitter().pre_tokenize(line)
    return [piece[a:b] for _, (a, b), _ in line.get_splits(
        offset_referential="original", offset_type="byte")]


def pieces(text: bytes, size: int = PIECE_BYTES):
    """The text in pieces of about ``size`` bytes that end behind a separator."""
    start = 0
    while len(text) - start > size:
        stop = start + size
        while stop < len(text) and text[stop - 1] not in SEPARATORS:
            stop += 1
        yield text[start:stop]
        start = stop
    yield text[start:]


def features(text: bytes, runs: int = RUNS, size: int = PIECE_BYTES) -> tuple[int, Counter]:
    """Number of words, and how often each run of one to ``runs`` words occurs."""
    n, found, before = 0, Counter(), []
    for piece in pieces(text.lower(), size):    # bytes.lower is A-Z only
        new = words(piece)
        n += len(new)
        found.update(new)
        line = before + new
        for length in range(2, runs + 1):
            first = max(0, len(before) - length + 1)   # runs that end in this piece
            found.update(b" ".join(line[k:k + length])
                         for k in range(first, len(line) - length + 1))
        before = line[max(0, len(line) - runs + 1):] if runs > 1 else []
    return n, found


def bucket_counts(rows: DataFrame, runs: int, buckets: int) -> DataFrame:
    """The columns but the text, n_words, n_features, and the buckets with their counts."""
    keep = [c for c in rows.columns if c != "text"]

    def count(batches):
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                sizes, totals, at, times, ends = [], [], [], [], [0]
                for text in texts.cast(pa.large_binary()).to_pylist():
                    n, found = features(text, runs)
                    own: Counter = Counter()
                    for feature, k in found.items():
                        own[zlib.crc32(feature) % buckets] += k
                    sizes.append(n)
                    totals.append(sum(own.values()))
                    at += own.keys()
                    times += own.values()
                    ends.append(len(at))
                bounds = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(c)) for c in keep),
                     pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()),
                     pa.ListArray.from_arrays(bounds, pa.array(at, pa.int32())),
                     pa.ListArray.from_arrays(bounds, pa.array(times, pa.int64()))],
                    names=[*keep, "n_words", "n_features", "buckets", "times"])

    kept = [f"`{c}` {k}" for c, k in rows.dtypes if c in keep]
    return rows.mapInArrow(count, ", ".join([
        *kept, "n_words bigint", "n_features bigint", "buckets array<int>", "times array<bigint>"]))


def histogram(counted: DataFrame, buckets: int) -> list[int]:
    """Features in each bucket over all rows; every task sends ``buckets`` sums at most."""

    def add(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(sums, batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy())
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["bucket", "n"])

    rows = counted.select("buckets", "times").mapInArrow(add, "bucket int, n bigint").groupBy(
        "bucket").agg(F.sum("n").alias("n")).collect()    # ``buckets`` rows at most
    found = [0] * buckets
    for row in rows:
        found[row["bucket"]] = row["n"]
    return found


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """Thousandths of the log ratio of the shares, each bucket counted once more, floored."""
    size, total, goal = len(corpus), sum(corpus), sum(target)
    return np.array([math.floor(1000 * math.log(
        float(t + 1) * float(total + size) / (float(s + 1) * float(goal + size))))
        for s, t in zip(corpus, target)], np.int64)


def weighted(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean gain of the features."""
    shared = counted.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches):
        gain = shared.value
        for batch in batches:
            lists = batch.column(3)
            at = lists.offsets.to_numpy()
            n = batch.column(2).to_numpy()
            sums = np.zeros(at[-1] - at[0] + 1, np.int64)
            np.cumsum(gain[lists.flatten().to_numpy()] * batch.column(4).flatten().to_numpy(),
                      out=sums[1:])
            total = sums[at[1:] - at[0]] - sums[at[:-1] - at[0]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(total // np.maximum(n, 1))],
                names=["doc_id", "n_words", "n_features", "weight"])

    kind = dict(counted.dtypes)["doc_id"]
    return counted.select("doc_id", "n_words", "n_features", "buckets", "times").mapInArrow(
        weigh, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise from the first 32 bits of a hash of seed and id, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((draw + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The ``n`` rows with ``rank`` 1, 2, 3... in the given order, sorted in ranges.

    A range's first rank is the number of rows in the ranges before it; those counts, one for
    each range, are broadcast.
    """
    sorted_ = rows.repartitionByRange(max(1, -(-n // RANKED_ROWS)), *order).sortWithinPartitions(
        *order).withColumn("_at", F.monotonically_increasing_id())
    sorted_ = materialise(sorted_)
    part = F.shiftright("_at", 33)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        "_part").collect()
    before, starts = 0, []
    for row in sizes:
        starts.append((row["_part"], before))
        before += row["n"]
    starts = rows.sparkSession.createDataFrame(starts, "_part bigint, _before bigint")
    return sorted_.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(
        "rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit(INSIDE)) + 1).drop(
        "_at", "_part", "_before")


def resample(docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS,
             seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT
             ) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``; undrawn rows have no rank.

    ``target`` has a column ``text``. ``percent`` of the rows with ``least_words`` words are
    drawn, those of the highest scores, ties to the smaller doc_id.
    """
    counted = materialise(bucket_counts(docs.select("doc_id", "text"), runs, buckets))
    goal = histogram(bucket_counts(target.select("text"), runs, buckets), buckets)
    rows = materialise(weighted(counted, gains(histogram(counted, buckets), goal)).withColumns({
        "score": F.col("weight") + noise(F.col("doc_id"), seed),
        "_row": F.monotonically_increasing_id()}))
    long_ = F.col("n_words") >= least_words
    # scores are whole thousandths of a bounded range, so there are few of them
    counts = rows.where(long_).groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("score")).collect()
    wanted = sum(r["n"] for r in counts) * percent // 100
    above, least = 0, None
    for row in counts:
        if above >= wanted:
            break
        above, least = above + row["n"], row["score"]
    out = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    high = F.col("score") >= least
    drawn = ranked(rows.where(long_ & high).select(*out, "_row"), above, [
        F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")])
    return drawn.select(*out, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank")
                        ).unionByName(rows.where(~(long_ & high)).select(
                            *out, F.lit(None).cast("long").alias("rank")))


# The same rows by SQL. The checksum follows its rule: a table of 256 remainders, then one
# step for each byte, on distinct words.
ORACLE_SQL = r"""
WITH lookup AS (
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1
        THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS remainders
    FROM range(256) t(i)),
taken AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS line
    FROM documents),
aimed AS (
    SELECT unnest(regexp_extract_all(
        translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
    FROM benchmark),
uses AS (SELECT doc_id, word, count(*) AS n
    FROM (SELECT doc_id, unnest(line) AS word FROM taken) GROUP BY ALL),
known AS (SELECT DISTINCT word FROM (SELECT word FROM uses UNION ALL SELECT word FROM aimed)),
placed AS (
    SELECT word, xor(4294967295, list_reduce(
        list_transform(range(strlen(word)), lambda k:
            ('0x' || substr(hex(encode(word)), 2 * k + 1, 2))::BIGINT),
        lambda c, b: xor(c // 256, remainders[(xor(c, b) % 256) + 1]), 4294967295)) % 10000 AS bucket
    FROM known, lookup),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM uses JOIN placed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*)::DOUBLE AS t FROM aimed JOIN placed USING (word) GROUP BY bucket),
gain AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)
        / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)))) AS gain
    FROM s FULL JOIN t USING (bucket)),
weights AS (
    SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight
    FROM uses JOIN placed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
    SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(
            sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT + 0.5::DOUBLE)
            / 4294967296::DOUBLE)))::BIGINT AS score
    FROM documents LEFT JOIN weights USING (doc_id)),
places AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place
    FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score,
    CASE WHEN place <= (SELECT count(*) FROM places) * 10 // 100 THEN place END AS rank
FROM scored LEFT JOIN places USING (doc_id)
"""
