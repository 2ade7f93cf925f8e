"""Release of the ball, and what the runner was doing at a moment before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadline.functions.codes import FIRST_BASE, FRAME, PITCHER, PLAY, RUNNER_FIRST
from leadline.functions.scalars import all_of, diff_quotient, distance, safe_divide, seconds
from leadline.operators.temporal import (
    attach_to_series, lookback, nearest_time, samples_before, sync_frames,
)
from leadline.session import materialise
from leadline.sources.tracking import Tracking

# Milliseconds looked back, and before release; feet from the pitcher.
LAGS = (100, 200, 300)
BEFORE_PICKOFF, BEFORE_PITCH = 725, 1250
RELEASED_AT = 1.0

CHUNK_MS = 60_000
NARROW_ROWS = 500_000
XY = ["field_x", "field_y"]


def lead_distance(x: Column, y: Column, base: tuple = FIRST_BASE) -> Column:
    return distance(x, y, base)


def runner_on_first_frames(t: Tracking) -> DataFrame:
    return t.player_pos.where(F.col("player_position") == RUNNER_FIRST).select(*FRAME, *XY)


def narrow(frames: DataFrame, plays: DataFrame | None) -> DataFrame:
    """Frames of the listed plays only, whatever the length of the list.

    A short list, counted first, is broadcast so that the frames are not shuffled: a key is a
    short text and an int, so it stays within some tens of megabytes. The rows are the same
    either way.
    """
    if plays is None:
        return frames
    keys = plays.select(*PLAY).distinct()
    few = keys.limit(NARROW_ROWS + 1).count() <= NARROW_ROWS
    keys = F.broadcast(keys) if few else keys.hint("shuffle_hash")
    return frames.join(keys, PLAY, "left_semi")


def release_time(t: Tracking, plays: DataFrame | None = None,
                 feet: float = RELEASED_AT) -> DataFrame:
    """(play, release_timestamp): first common frame with the ball away from the pitcher.

    Both streams are aggregated by frame in one go: smallest and largest coordinates.
    Copies collapse before the shuffle, and nothing is sorted or paired. Where a frame
    has one place for the ball and one for the pitcher, that is the frame. Plays with a
    frame that contradicts itself, early enough to matter, are done by pairing its rows.
    """
    pitcher = t.player_pos.where(F.col("player_position") == PITCHER).select(*FRAME, *XY).dropna()
    ball = t.ball_pos.select(*FRAME, "ball_position_x", "ball_position_y").dropna()
    pitcher, ball = narrow(pitcher, plays), narrow(ball, plays)

    names = ["bx", "by", "px", "py"]
    none = F.lit(None).cast("double")
    both = ball.select(
        *FRAME, F.col("ball_position_x").alias("bx"), F.col("ball_position_y").alias("by"),
        none.alias("px"), none.alias("py"),
    ).unionByName(pitcher.select(
        *FRAME, none.alias("bx"), none.alias("by"), F.col("field_x").alias("px"),
        F.col("field_y").alias("py")))
    frames = both.groupBy(*FRAME).agg(
        *[F.min(n).alias(n) for n in names], *[F.max(n).alias(f"{n}_max") for n in names])
    frames = frames.where(F.col("bx").isNotNull() & F.col("px").isNotNull())
    clear = all_of(F.col(n) == F.col(f"{n}_max") for n in names)
    away = distance(F.col("bx"), F.col("by"), (F.col("px"), F.col("py"))) >= F.lit(float(feet))
    found = materialise(frames.groupBy(*PLAY).agg(
        F.min(F.when(clear & away, F.col("timestamp"))).alias("release_timestamp"),
        F.min(F.when(~clear, F.col("timestamp"))).alias("unclear")))

    released = F.col("release_timestamp")
    doubtful = F.coalesce(F.col("unclear") < released, F.col("unclear").isNotNull())
    settled = found.where(~doubtful & released.isNotNull()).select(*PLAY, released)
    redo = found.where(doubtful).select(*PLAY)
    if redo.isEmpty():
        return settled
    apart = distance(F.col("ball_position_x"), F.col("ball_position_y"),
                     (F.col("field_x"), F.col("field_y")))
    paired = sync_frames(*[
        attach_to_series(df.distinct(), redo, PLAY, "timestamp", CHUNK_MS, NARROW_ROWS)
        for df in (ball, pitcher)], FRAME)
    return settled.unionByName(
        paired.where(apart >= F.lit(float(feet)))
        .groupBy(*PLAY).agg(F.min("timestamp").alias("release_timestamp")))


def released(t: Tracking, plays: DataFrame, releases: DataFrame | None = None) -> DataFrame:
    """``release_time`` of the listed plays, out of a stored table of all plays if there is one."""
    return release_time(t, plays) if releases is None else narrow(releases, plays)


def kinematics(df: DataFrame, form: str = "endpoint", undefined: str = "null",
               base: tuple = FIRST_BASE) -> DataFrame:
    """Add lead distance, velocity, acceleration and jerk from ``near`` and ``back_<d>``.

    ``endpoint`` divides changes of velocity by the newest time step; an undefined
    velocity is null, or 0 with ``undefined='zero'``. ``midpoint`` divides by the time
    between the middles of the intervals and keeps only rows with all four samples.
    """
    points = ["near", *[f"back_{d}" for d in LAGS]]
    df = df.withColumns({
        **{f"_t{i}": F.col(f"{p}.timestamp") for i, p in enumerate(points)},
        **{f"_l{i}": lead_distance(F.col(f"{p}.field_x"), F.col(f"{p}.field_y"), base)
           for i, p in enumerate(points)},
    })
    t = [F.col(f"_t{i}") for i in range(4)]
    lead = [F.col(f"_l{i}") for i in range(4)]
    v = [F.col(f"_v{i}") for i in range(3)]

    if form == "endpoint":
        value = F.lit({"null": None, "zero": 0.0}[undefined]).cast("double")
        df = df.withColumns({
            f"_v{i}": diff_quotient(lead[i], lead[i + 1], t[i], t[i + 1], value)
            for i in range(3)})
        steps = [seconds(t[0] - t[1]), seconds(t[1] - t[2])]
        scale = F.lit(1.0)
    elif form == "midpoint":
        scale = F.lit(1000.0)
        df = df.where(t[0].isNotNull() & t[1].isNotNull() & t[2].isNotNull() & t[3].isNotNull())
        df = df.withColumns({
            f"_v{i}": safe_divide(lead[i] - lead[i + 1], (t[i] - t[i + 1]).cast("double")) * scale
            for i in range(3)})
        half = F.lit(2.0)
        middle = [(t[i] + t[i + 1]) / half for i in range(3)]
        steps = [middle[0] - middle[1], middle[1] - middle[2]]
    else:
        raise ValueError(f"unknown form {form}")

    df = df.withColumns({f"_a{i}": safe_divide(v[i] - v[i + 1], steps[i]) * scale
                         for i in range(2)})
    return df.withColumns({
        "lead_distance": lead[0], "velocity": v[0], "acceleration": F.col("_a0"),
        "jerk": safe_divide(F.col("_a0") - F.col("_a1"), steps[0]) * scale,
    }).drop(*[f"_{n}{i}" for n, k in (("t", 4), ("l", 4), ("v", 3), ("a", 2)) for i in range(k)])


def runner_lookback(t: Tracking) -> DataFrame:
    """Every frame of the runner from first as ``near``, with its earlier samples."""
    frames = runner_on_first_frames(t)
    return lookback(frames, PLAY, "timestamp", XY, LAGS, CHUNK_MS).withColumn(
        "near", F.struct("timestamp", *XY))


def moment_before(t: Tracking, targets: DataFrame, ties: str = "early",
                  form: str = "endpoint", undefined: str = "null") -> DataFrame:
    """Kinematics of the runner from first at the frame nearest to ``at``, per play.

    ``targets`` hold ``at`` per play, from stored tables; their other columns are kept.
    First the time of that frame, then the samples around it. Few targets are broadcast
    and the frames stay in place; many are joined on (play, chunk).
    """
    frames = runner_on_first_frames(t)
    near = materialise(nearest_time(frames, targets, PLAY, "timestamp", "at", CHUNK_MS, ties,
                                    NARROW_ROWS))
    sampled = samples_before(frames, near, PLAY, "timestamp", "near_time", XY, LAGS, CHUNK_MS,
                             NARROW_ROWS)
    rows = kinematics(sampled, form, undefined).drop(*[f"back_{d}" for d in LAGS])
    return targets.join(rows, PLAY)
