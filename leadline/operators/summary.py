"""Column summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Rows (bin, lo, hi, n) for equal bins from minimum to maximum; the last is closed.

    Two passes, both map-side aggregates; the only thing brought back is min and max.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    low, high = values.agg(F.min("v"), F.max("v")).first()
    edges = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    if low is None:
        return edges.where("false").select(
            "bin", *[F.lit(0.0).alias(c) for c in ("lo", "hi")], F.lit(0).cast("bigint").alias("n"))
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins
    place = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(step)), F.lit(bins - 1))
    counts = values.groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return edges.join(counts, "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(step)).alias("lo"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(step)).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"))


def spread_table(df: DataFrame, columns) -> DataFrame:
    """Rows (feature, std_samp, std_pop), one aggregate over all columns."""
    one = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns
                   for n, f in (("s", F.stddev_samp), ("p", F.stddev_pop))])
    table = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"s_{c}").alias("std_samp"),
                 F.col(f"p_{c}").alias("std_pop"))
        for c in columns
    ])
    return one.select(F.inline(table))
