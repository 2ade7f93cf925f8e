"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The rows lie in source partitions. How many rows each partition sends to each shard is drawn
from the law that a uniform shuffle of all rows would follow (multivariate hypergeometric,
with the wanted shard sizes as exact margins). Each partition permutes its rows and deals
them out by those counts; each shard permutes what it got. Rows are moved and ordered by
DataFrame operations only; the driver draws the matrix, partitions times shards numbers.

Law ``rows``: shard sizes differ by one at most, the first shards being the larger ones.

Defined cases: a null text has size 1 and the checksum of the empty text; repeated rows are
rows of their own and may go to different shards; columns other than doc_id and text are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadline.session import materialise

SHARDS, SEED = 16, 20_240_607
GROUP_ROWS = 20_000   # rows meant to be ordered together in one group


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` balls, taken without replacement, are good.

    The probability of each outcome follows from that of its neighbour; summation starts at
    the most likely outcome and goes outwards, so it ends after a few standard deviations.
    """
    from math import exp, lgamma

    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low

    def log_choose(n: int, k: int) -> float:
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    middle = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    peak = exp(log_choose(good, middle) + log_choose(bad, drawn - middle)
               - log_choose(good + bad, drawn))
    left = rng.random() - peak
    up, down, p_up, p_down = middle, middle, peak, peak
    while left > 0 and (p_up > 0 or p_down > 0):
        if up < high and p_up > 0:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        else:
            p_up = 0.0
        if down > low and p_down > 0:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        else:
            p_down = 0.0
    return middle


def matrix(rows: list[int], sizes: list[int], seed: int = SEED) -> list[list[int]]:
    """Counts with the given row and column sums, as a uniform shuffle would give them."""
    rng = random.Random(seed)
    left, drawn = list(sizes), []
    for n in rows:
        line, need, pool = [], n, sum(left)
        for k, room in enumerate(left):
            pool -= room
            take = hypergeometric(rng, room, pool, need)
            line.append(take)
            need -= take
            left[k] -= take
        drawn.append(line)
    return drawn


def ranked(df: DataFrame, by: str, order: str, groups: int) -> DataFrame:
    """``_rank`` from 0 within ``by`` in the order of the random number ``order``.

    A value of ``by`` is cut into ``groups`` ranges of the number, each ordered on its own;
    the rows before a range are counted. The rank is the same for any number of ranges.
    """
    cut = df.withColumn("_range", F.least(F.floor(F.col(order) * groups), F.lit(groups - 1)))
    sizes = cut.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(by, "_range", (F.sum("_n").over(
        Window.partitionBy(by).orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy(by, "_range").orderBy(order, "_row")
    return cut.withColumn("_rank", F.row_number().over(inside)).join(
        sizes, [by, "_range"]).withColumn(
        "_rank", F.col("_rank") - 1 + F.col("_before")).drop("_range", "_before")


def unit(seed: int):
    """A number in [0, 1) from the row's number; 53 bits of a 64-bit hash."""
    return F.shiftrightunsigned(F.xxhash64("_row", F.lit(seed)), 11) / F.lit(float(1 << 53))


def shards(docs: DataFrame, count: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    # row numbers and partitions are stored: from here on they are data, not plan
    stored = materialise(docs.select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"), F.spark_partition_id().alias("_source"),
        F.monotonically_increasing_id().alias("_row")))
    sent = sorted((r["_source"], r["n"]) for r in stored.groupBy("_source").agg(
        F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in sent)
    sizes = [total // count + (k < total % count) for k in range(count)]
    drawn = matrix([n for _, n in sent], sizes, seed)
    # partitions times shards numbers: the counts above, summed from the left
    lines = [(p, [sum(line[:k + 1]) for k in range(count)]) for (p, _), line in zip(sent, drawn)]
    ends = docs.sparkSession.createDataFrame(lines, "_source int, _ends array<bigint>")
    groups = max(1, total // (max(1, len(sent)) * GROUP_ROWS))
    local = ranked(stored.withColumn("_u", unit(seed)), "_source", "_u", groups)
    dealt = local.join(F.broadcast(ends), "_source").withColumn(
        "shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).cast("int"))
    # stored, since the second permutation reads it twice
    dealt = materialise(dealt.select("doc_id", "size", "text_crc32", "shard", "_row"))
    again = ranked(dealt.withColumn("_v", unit(seed + 1)), "shard", "_v",
                   total // (count * GROUP_ROWS) + 1)
    return again.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                        F.col("_rank").cast("long").alias("slot"),
                        F.lit(None).cast("int").alias("grown_shard"))
