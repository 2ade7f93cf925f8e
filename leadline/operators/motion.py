"""Speed and path of points that move, per trajectory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadline.functions.scalars import distance, safe_divide, seconds
from leadline.operators.chunks import CHUNK, OWN, own_rows, spread

STEP, SPEED, COVERED = "step", "speed", "covered"


def one_place(df: DataFrame, part, time: str, x: str, y: str, width: int, span: int) -> DataFrame:
    """Chunked rows with the smallest (x, y) per instant; rows without a time are left out.

    The rows move once at most, to their (track, chunk), and not at all if they lie together
    by track already. The windows and sums per chunk that follow find this order.
    """
    rows = spread(df.select(*part, time, x, y).where(F.col(time).isNotNull()), time, width, span)
    w = Window.partitionBy(*part, CHUNK).orderBy(time, x, y)
    first = F.lag(time).over(w)
    return rows.withColumn("_seen", first).where(
        F.col("_seen").isNull() | (F.col("_seen") != F.col(time))).drop("_seen")


def with_motion(chunked: DataFrame, part, time: str, x: str, y: str, span: int) -> DataFrame:
    """Add trailing speed per second, the time it covers, and the step inside the chunk.

    All three come from one sort. The step is null where the row before belongs to an
    earlier chunk; ``trajectories`` adds that one.
    """
    w = Window.partitionBy(*part, CHUNK).orderBy(time)
    trailing = w.rangeBetween(-span, 0)
    here = F.struct(time, x, y, OWN)
    seen = chunked.withColumns({"_first": F.first(here).over(trailing),
                                "_prev": F.lag(here).over(w)})
    covered = F.col(time) - F.col(f"_first.{time}")
    moved = distance(F.col(x), F.col(y), (F.col(f"_first.{x}"), F.col(f"_first.{y}")))
    step = distance(F.col(x), F.col(y), (F.col(f"_prev.{x}"), F.col(f"_prev.{y}")))
    return seen.withColumns({
        SPEED: safe_divide(moved, seconds(covered)),
        COVERED: covered,
        STEP: F.when(F.col(f"_prev.{OWN}"), step),
    }).drop("_first", "_prev")


def trajectories(moving: DataFrame, part, time: str, x: str, y: str, **measures) -> DataFrame:
    """One row per trajectory: ``path`` and further maxima.

    First per chunk, where the rows already are; then over the few chunk rows of each
    trajectory, which also adds the steps between chunks. ``measures`` are columns whose
    maximum is wanted.
    """
    point = F.struct(time, x, y)
    per_chunk = (
        moving.where(F.col(OWN)).groupBy(*part, CHUNK).agg(
            F.sum(STEP).alias(STEP), F.min(point).alias("_in"), F.max(point).alias("_out"),
            *[F.max(c).alias(n) for n, c in measures.items()])
    )
    w = Window.partitionBy(*part).orderBy(CHUNK)
    linked = per_chunk.withColumn("_from", F.lag("_out").over(w))
    across = distance(F.col(f"_in.{x}"), F.col(f"_in.{y}"),
                      (F.col(f"_from.{x}"), F.col(f"_from.{y}")))
    total = F.coalesce(F.col(STEP), F.lit(0.0)) + F.coalesce(across, F.lit(0.0))
    return linked.groupBy(*part).agg(
        F.sum(total).alias("path"), *[F.max(n).alias(n) for n in measures])


def trailing_speed(df: DataFrame, part, time: str, x: str, y: str, span: int,
                   width: int) -> DataFrame:
    """(part, time, x, y) with ``speed`` and ``covered``, one row per instant."""
    moving = with_motion(one_place(df, part, time, x, y, width, span), part, time, x, y, span)
    return own_rows(moving.drop(STEP)).select(*part, time, x, y, SPEED, COVERED)


def path_length(df: DataFrame, part, time: str, x: str, y: str, width: int) -> DataFrame:
    """(part, path): length of each trajectory."""
    moving = with_motion(one_place(df, part, time, x, y, width, 0), part, time, x, y, 0)
    return trajectories(moving, part, time, x, y)
