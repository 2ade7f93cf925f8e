"""A join that keeps hot keys apart, for tables whose groups may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_ROWS = 512     # rows of one key meant to meet in one task
TASK_ROWS = 5000     # rows with their texts in a task of a join with a stated number of tasks
HOT_KEYS = 2000      # a key is hot from this fraction of the rows on, so there are no more


def hot_join(big: DataFrame, small: DataFrame, on: str,
             counted: DataFrame | None = None, how: str | None = None) -> DataFrame:
    """Inner join on one column; ``small`` has one row for each value of it.

    Keys of at least ``GROUP_ROWS`` rows and a ``HOT_KEYS``-th of ``big`` are dealt over
    shares of ``GROUP_ROWS`` rows by a hash of the row; only that list, at most ``HOT_KEYS``
    keys, is broadcast. All rows are kept; a null key matches nothing. ``counted`` is a stored
    table with the rows of ``big`` or more, to count the keys in. ``how`` is a join hint for
    the side of ``small``, such as "shuffle_hash"; without one Spark decides by size. With one both
    sides are dealt over a number of tasks stated by the rows, or adaptive execution would put the shares of
    a hot key together again where they have few bytes.
    """
    big = big.where(F.col(on).isNotNull())
    counted = big if counted is None else counted
    total = counted.count()
    if total < GROUP_ROWS:  # no key can be hot
        return big.join(small, on)
    sizes = counted.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= GROUP_ROWS)
    hot = sizes.where(F.col("_n") >= total / HOT_KEYS).select(
        F.col(on).alias("_key"), F.ceil(F.col("_n") / GROUP_ROWS).cast("int").alias("_shares"))
    hot = F.broadcast(hot)
    dealt = big.join(hot, F.col(on) == F.col("_key"), "left").withColumn(
        "_share", F.coalesce(F.pmod(F.xxhash64(*big.columns), F.col("_shares")), F.lit(0)))
    copies = small.join(hot, F.col(on) == F.col("_key"), "left").withColumn(
        "_share", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_shares"), F.lit(1)) - 1))
    ).withColumn("_share", F.col("_share").cast("long"))
    dealt, copies = dealt.drop("_key", "_shares"), copies.drop("_key", "_shares")
    if how:
        tasks = max(int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_ROWS)
        dealt, copies = (side.repartition(tasks, on, "_share") for side in (dealt, copies))
        copies = copies.hint(how)
    return dealt.join(copies, [on, "_share"]).drop("_share")


def parts(rows: int) -> int:
    """Tasks for a table of about ``rows`` short rows."""
    return max(8, rows // 20_000)


def narrow_join(big: DataFrame, small: DataFrame, on: str, total: int,
                how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """Inner or left join on one column; ``small`` has one short row for each value of it.

    The rows of ``small`` for hot keys, as ``hot_join`` defines them for the ``total`` rows of
    ``big``, are at most ``HOT_KEYS`` short ones and are broadcast, so rows of hot keys are
    not moved at all; the others meet by a plain join. All rows are kept. ``sizes`` has the
    number of rows ``_n`` of every key of ``small`` in ``big``, where it is known.
    """
    if total < GROUP_ROWS:  # no key can be hot
        return big.join(small, on, how)
    if sizes is None:
        sizes = big.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.where(F.col("_n") >= max(GROUP_ROWS, total / HOT_KEYS)).select(on)
    meets = F.broadcast(small.join(F.broadcast(hot), on, "left_semi"))
    return big.join(F.broadcast(hot), on, "left_semi").join(meets, on, how).unionByName(
        big.join(F.broadcast(hot), on, "left_anti").join(small, on, how))
