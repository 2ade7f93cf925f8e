"""Joins, per-key choices and overlays. They know no column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000   # rows and bytes up to which a counted side is broadcast
BROADCAST_BYTES = 64 << 20
HOT_SHARE = 0.001          # a key above this share of all rows is salted
SALTS = 64                 # tasks a hot key is spread over


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join by columns of the same names in which null equals null; the left keys stay.

    Holds for inner, left, left_semi and left_anti.
    """
    keys = list(keys)
    if not keys:
        return left.join(right, keys, how)
    other = right.select(*[F.col(c).alias(f"_of_{c}" if c in keys else c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]
    return left.join(other, same, how).drop(*[f"_of_{c}" for c in keys])


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Is ``df`` within the bounds of a broadcast? One pass over ``rows`` + 1 rows at most.

    The size is that of the rows as JSON text, which is more than they take in a broadcast for
    all but short numbers.
    """
    text = F.octet_length(F.to_json(F.struct(*df.columns)))
    n, weight = df.limit(rows + 1).agg(
        F.count(F.lit(1)), F.coalesce(F.sum(text), F.lit(0))).first()
    return n <= rows and weight <= size


def spread_join(big: DataFrame, small: DataFrame, keys, how: str = "inner",
                broadcast_rows: int = BROADCAST_ROWS, salts: int = SALTS,
                null_safe: bool = False) -> DataFrame:
    """Join in which no key of ``big`` ends up in one task.

    ``small`` is measured. Up to ``broadcast_rows`` rows and ``BROADCAST_BYTES`` it is
    broadcast and ``big`` does not move. Beyond that both sides are shuffled, and the
    hot keys of ``big`` get a salt: its rows are spread by a hash over all columns and
    the matching rows of ``small`` are repeated once per salt. There can be at most
    1 / HOT_SHARE hot keys, so that list may be broadcast. Rows of ``big`` with a null in
    the key match nothing (unless null equals null) and are dealt out by the same hash. Holds for inner, left,
    left_semi and left_anti; rows with the same key on ``small`` all match. With
    ``null_safe`` null equals null.
    """
    keys = list(keys)

    def join(left, right, on, how):
        return null_safe_join(left, right, on, how) if null_safe else left.join(right, on, how)

    if fits_broadcast(small, broadcast_rows):
        return join(big, F.broadcast(small), keys, how)

    counts = big.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t")).select(F.col("_t") * HOT_SHARE).scalar()
    hot = F.broadcast(counts.where(F.col("_n") > total).select(*keys, F.lit(True).alias("_hot")))

    salt = F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")
    dealt = F.coalesce(F.col("_hot"), F.lit(False))
    if not null_safe:
        for c in keys:
            dealt = dealt | F.col(c).isNull()
    salted = join(big, hot, keys, "left").withColumn(
        "_salt", F.when(dealt, salt).otherwise(F.lit(0))).drop("_hot")
    repeated = join(small, hot, keys, "left").withColumn("_salt", F.explode(
        F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
        .otherwise(F.array(F.lit(0))))).drop("_hot")
    return join(salted, repeated, [*keys, "_salt"], how).drop("_salt")


def attach_lookup(df: DataFrame, table: DataFrame, left_on: str, right_on: str,
                  **kwargs) -> DataFrame:
    """Left join of a table that has one row per ``right_on``; the key keeps its left name."""
    keyed = table.withColumnRenamed(right_on, left_on)
    return spread_join(df, keyed, [left_on], "left", **kwargs).select(
        *df.columns, *[c for c in keyed.columns if c != left_on])


def keep_keys(df: DataFrame, other: DataFrame, keys) -> DataFrame:
    """Rows whose key occurs in ``other``."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_semi")


def drop_keys(df: DataFrame, other: DataFrame, keys) -> DataFrame:
    """Rows whose key does not occur in ``other``; a null key occurs nowhere."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_anti")


def exists_flag(df: DataFrame, other: DataFrame, keys, name: str) -> DataFrame:
    """Boolean column: does the key occur in ``other``."""
    marks = other.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(marks, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def top1(df: DataFrame, part, order: list[Column]) -> DataFrame:
    """First row per key in a given order.

    Spark turns ``row_number() = 1`` into a group limit that already runs before the
    shuffle, so each task sends one row per key. Give an order without ties.
    """
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_per(df: DataFrame, keys, order) -> DataFrame:
    """Keep-first dedupe by column names, nulls last."""
    return top1(df, keys, [F.asc_nulls_last(c) for c in order])


def min_sample(df: DataFrame, count: str, at_least: int) -> DataFrame:
    return df.where(F.col(count) >= at_least)


def plausible(df: DataFrame, bounds: dict) -> DataFrame:
    """Keep rows inside closed bounds; None leaves a side open."""
    for name, (low, high) in bounds.items():
        if low is not None:
            df = df.where(F.col(name) >= F.lit(float(low)))
        if high is not None:
            df = df.where(F.col(name) <= F.lit(float(high)))
    return df


def exclude(df: DataFrame, column: str, values) -> DataFrame:
    return df.where(~F.col(column).isin(*values))


def split_by(df: DataFrame, column: str, values) -> dict:
    """One frame per value. Give a stored table; each part reads it anew."""
    return {v: df.where(F.col(column) == v) for v in values}


def overlay_labels(df: DataFrame, labels: DataFrame, keys, label: str) -> DataFrame:
    """Replace ``label`` by the one of a keyed table; rows without one are dropped."""
    table = labels.select(*keys, label).where(F.col(label).isNotNull())
    return df.drop(label).join(table, list(keys))


def with_constants(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})
