"""Exact order statistics without sorting a group in one task.

The rank of a value is (rows in smaller value ranges) + (rank inside its range). The
value ranges come from Spark's quantile sketch over the whole column, so each holds
about the same number of rows and no (group, range) cell can exceed that, even if one
group has most rows. The ranges only decide how work is split: any ranges give the same
exact result. Equal values are counted before they are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadline.operators.relational import null_safe_join, spread_join
from leadline.session import materialise

RANGE_ROWS = 200_000        # rows of a range that is sorted in one task
FEWEST, MOST_RANGES = 16, 50_000
BEFORE = (Window.unboundedPreceding, -1)


def ranges_for(rows: int) -> int:
    """Ranges that hold about ``RANGE_ROWS`` rows each, up to 50,000: beyond ten thousand million
    rows a range grows, but it is sorted as counted distinct values, and sorting spills."""
    return min(MOST_RANGES, max(FEWEST, -(-rows // RANGE_ROWS)))


def with_ranges(df: DataFrame, columns, ranges: int | None = None) -> DataFrame:
    """Add ``_range_<c>`` for numeric columns; one sketch job for all of them.

    The number of ranges follows the number of rows unless it is given.
    """
    ranges = ranges_for(df.count()) if ranges is None else ranges
    shares = [i / ranges for i in range(1, ranges)]
    cuts = df.approxQuantile(list(columns), shares, 0.5 / ranges) if shares else [[]] * len(columns)
    inf = float("inf")
    splits = [[-inf, *sorted(set(c) - {inf, -inf}), inf] for c in cuts]
    splits = [s if len(s) > 2 else [-inf, 0.0, inf] for s in splits]
    return Bucketizer(
        inputCols=list(columns), outputCols=[f"_range_{c}" for c in columns],
        splitsArray=splits, handleInvalid="keep").transform(df)


def long_form(df: DataFrame, columns, group=(), ranges: int | None = None) -> DataFrame:
    """One row (group, feature, value, _range) per non-null value of ``columns``."""
    doubles = df.select(*group, *[F.col(c).cast("double").alias(c) for c in columns])
    cut = with_ranges(doubles, columns, ranges)
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"),
                 F.col(f"_range_{c}").cast("int").alias("_range"))
        for c in columns
    ])
    return cut.select(*group, F.inline(cells)).where(F.col("value").isNotNull())


def _range_offsets(cells: DataFrame, group, counts) -> DataFrame:
    """Per (group, range): ``<c>_before`` rows in smaller ranges, ``<c>_all`` in the group.

    At most one row per range goes through these windows for each group.
    """
    w = Window.partitionBy(*group)
    totals = cells.groupBy(*group, "_range").agg(*[F.sum(c).alias(c) for c in counts])
    return totals.withColumns({
        **{f"{c}_before": F.coalesce(F.sum(c).over(w.orderBy("_range").rowsBetween(*BEFORE)),
                                     F.lit(0)) for c in counts},
        **{f"{c}_all": F.sum(c).over(w) for c in counts},
    })


def quantile_table(df: DataFrame, columns, shares, group=(), ranges: int | None = None) -> DataFrame:
    """Exact interpolated percentiles as rows (group, feature, n, share, value).

    Three passes: sketch, counts per range, and the values of just those ranges that
    hold a wanted rank; only about shares / ranges of the rows are shuffled.
    """
    by = [*group, "feature"]
    rows = long_form(df, columns, group, ranges)
    counts = rows.groupBy(*by, "_range").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    counts = counts.withColumns({
        "_before": F.coalesce(F.sum("n").over(w.orderBy("_range").rowsBetween(*BEFORE)), F.lit(0)),
        "_all": F.sum("n").over(w),
    })

    ranks = {i: F.lit(float(p)) * (F.col("_all") - 1) for i, p in enumerate(shares)}
    hit = reduce(lambda a, b: a | b, [
        (F.ceil(r) >= F.col("_before")) & (F.floor(r) < F.col("_before") + F.col("n"))
        for r in ranks.values()
    ])
    wanted = counts.where(hit).select(*by, "_range", "_before", "_all")
    if group:
        # stored, so that it can be counted before it is broadcast
        kept = spread_join(rows, materialise(wanted), [*by, "_range"], null_safe=True)
    else:
        # two ranges per share and column at most
        kept = rows.join(F.broadcast(wanted), [*by, "_range"])
    cells = (
        kept.groupBy(*by, "_range", "_before", "_all", "value").agg(F.count("*").alias("n"))
    )
    inside = Window.partitionBy(*by, "_range").orderBy("value").rowsBetween(*BEFORE)
    below = F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    placed = cells.withColumn("_below", below)
    # the value at rank r is the greatest value with no more than r rows below it
    picks = []
    for i, r in ranks.items():
        picks += [
            F.max(F.when(F.col("_below") <= F.floor(r), F.col("value"))).alias(f"_lo{i}"),
            F.max(F.when(F.col("_below") <= F.ceil(r), F.col("value"))).alias(f"_hi{i}"),
            F.max(r - F.floor(r)).alias(f"_w{i}"),
        ]
    picked = placed.groupBy(*by).agg(F.max("_all").alias("n"), *picks)
    table = F.array(*[
        F.struct(F.lit(float(p)).alias("share"), (
            F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")
        ).alias("value"))
        for i, p in enumerate(shares)
    ])
    return picked.select(*by, "n", F.inline(table))


def percentile(df: DataFrame, column: str, share: float, group=(),
               ranges: int | None = None) -> DataFrame:
    """(group, n, value) for one exact percentile of one column."""
    return quantile_table(df, [column], [share], group, ranges).drop("feature", "share")


def medians(df: DataFrame, columns, ranges: int | None = None) -> dict:
    """Exact medians on the driver: one number per column, None where all is null."""
    found = quantile_table(df, columns, [0.5], ranges=ranges).collect()
    return {c: None for c in columns} | {r["feature"]: r["value"] for r in found}


def running_counts(df: DataFrame, value: str, counts: dict, group=(),
                   ranges: int | None = None) -> DataFrame:
    """Per (group, distinct value): each count, ``<c>_below`` and ``<c>_all``.

    ``counts`` maps names to aggregate columns, such as a count or a sum of flags.
    """
    by = list(group)
    cut = with_ranges(df.where(F.col(value).isNotNull()), [value], ranges).withColumnRenamed(
        f"_range_{value}", "_range")
    cells = cut.groupBy(*by, "_range", value).agg(*[c.alias(n) for n, c in counts.items()])
    offsets = _range_offsets(cells, by, counts).drop(*counts)
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(*BEFORE)
    placed = cells.withColumns({
        f"_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in counts})
    return null_safe_join(placed, offsets, [*by, "_range"]).select(
        *by, value, *counts,
        *[(F.col(f"{c}_before") + F.col(f"_{c}")).alias(f"{c}_below") for c in counts],
        *[f"{c}_all" for c in counts])


def rank_pct(df: DataFrame, column: str, name: str, ranges: int | None = None) -> DataFrame:
    """Add the percentile rank of a column, 0 to 100, ties averaged; null stays null.

    Values that make up more than a thousandth of the rows (so under a thousand of them)
    are attached by broadcast, the others by a shuffle on the value.
    """
    at = running_counts(df, column, {"n": F.count("*")}, ranges=ranges)
    ranked = at.withColumn(
        name, (F.col("n_below") + (F.col("n") + 1) / F.lit(2.0)) / F.col("n_all") * 100)
    often = F.col("n") * 1000 > F.col("n_all")
    hot = F.broadcast(ranked.where(often).select(column, name))
    cold = ranked.where(~often).select(column, F.col(name).alias("_cold"))
    return (
        df.join(hot, [column], "left")
        .withColumn("_key", F.when(F.col(name).isNull(), F.col(column)))
        .join(cold.withColumnRenamed(column, "_key"), ["_key"], "left")
        .withColumn(name, F.coalesce(name, "_cold")).drop("_key", "_cold")
        .select(*df.columns, name)
    )


def roc_auc(df: DataFrame, label: str, score: str, group=(), ranges: int | None = None,
            count: str | None = None) -> DataFrame:
    """(group, auc) from 0/1 labels and scores, ties counted half.

    Null where a group has one class only. ``count`` names a column that says how many equal
    rows a row stands for.
    """
    flag, n = F.col(label).cast("bigint"), F.lit(1) if count is None else F.col(count)
    at = running_counts(df, score, {"pos": F.sum(flag * n), "neg": F.sum((1 - flag) * n)}, group,
                        ranges)
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / F.lit(2.0)))
    pairs = F.max(F.col("pos_all").cast("double") * F.col("neg_all"))
    return at.groupBy(*group).agg((won / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def roc_auc_ovr(df: DataFrame, label: str, scores: dict, group=(),
                ranges: int | None = None) -> DataFrame:
    """(group, auc): each class against the rest, weighted by its number of rows.

    ``scores`` maps class to score column. A class that is missing or the only one has
    no AUC and no weight.
    """
    table = F.array(*[
        F.struct(F.lit(c).alias("class"), (F.col(label) == F.lit(c)).cast("int").alias("hit"),
                 F.col(s).alias("score"))
        for c, s in scores.items()
    ])
    rows = df.select(*group, F.inline(table))
    by = [*group, "class"]
    each = roc_auc(rows, "hit", "score", by, ranges)
    sizes = rows.groupBy(*by).agg(F.sum("hit").alias("n"))
    weight = F.when(F.col("auc").isNotNull(), F.col("n"))
    return null_safe_join(each, sizes, by).groupBy(*group).agg(
        (F.sum(F.col("auc") * F.col("n")) / F.nullif(F.sum(weight).cast("double"), F.lit(0.0)))
        .alias("auc"))


def stratified_folds(df: DataFrame, label: str, folds: int, key: Column, ties, seed: int = 0,
                     cells: int | None = None) -> DataFrame:
    """Add ``fold``: rows of each class dealt out in turn in a seeded order.

    The order is a hash of the integer ``key``, then ``ties``. The hash range is cut into
    even cells, as many as the rows ask for; a row's number is the cell's offset in its class
    plus its number in the cell, so a large class is numbered by many tasks. Rows without a label are dealt out
    like a class of their own.
    """
    # The hash is written in plain integer arithmetic to be portable.
    modulus = 1_000_003
    cells = min(modulus, ranges_for(df.count())) if cells is None else cells
    hashed = F.pmod(F.pmod(key.cast("bigint"), F.lit(modulus)) * 7919 + seed * 104729,
                    F.lit(modulus))  # reduced first, so that no key overflows
    rows = df.withColumn("_h", hashed).withColumn(
        "_cell", F.floor(F.col("_h") * cells / F.lit(modulus)).cast("int"))
    sizes = rows.groupBy(label, "_cell").agg(F.count("*").alias("_n"))
    along = Window.partitionBy(label).orderBy("_cell").rowsBetween(*BEFORE)
    offsets = sizes.select(F.col(label).alias("_of"), F.col("_cell").alias("_at"), F.coalesce(
        F.sum("_n").over(along), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(label, "_cell").orderBy(
        "_h", *[F.asc_nulls_last(t) for t in ties])
    return (
        rows.withColumn("_i", F.row_number().over(inside))
        .join(offsets, F.col(label).eqNullSafe(F.col("_of"))
              & F.col("_cell").eqNullSafe(F.col("_at")))
        .withColumn("fold", ((F.col("_before") + F.col("_i") - 1) % folds).cast("int"))
        .select(*df.columns, "fold")
    )
