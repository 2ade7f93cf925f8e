"""Sprint speed of runners, pop time of catchers, number of games."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadline.functions.codes import (
    ACQUIRED, CATCHER, MIDDLE_INFIELD, OCCUPANTS, PLAY, RUNNERS, THROW,
)
from leadline.functions.scalars import seconds
from leadline.operators.motion import COVERED, SPEED, one_place, trajectories, with_motion
from leadline.operators.ranking import percentile
from leadline.operators.relational import min_sample, plausible
from leadline.plans.moments import CHUNK_MS, XY
from leadline.session import materialise
from leadline.sources.tracking import Tracking

# Window and least cover in ms, feet, feet per second, seconds, sample.
WINDOW_MS, LEAST_COVER_MS = 1000, 750
LEAST_PATH = 45
SPEED_RANGE = (20.0, 40.0)
SPEED_SHARE = 0.8
POP_RANGE = (1.6, 2.5)
LEAST_SAMPLE = 3


def runner_ids(t: Tracking) -> DataFrame:
    """(play, player_position, runner_id) for every occupied base of every play."""
    seats = F.array(*[
        F.struct(F.lit(code).alias("player_position"), F.col(base).alias("runner_id"))
        for code, base in OCCUPANTS.items()
    ])
    return (
        t.game_info.select("game_str", F.col("play_per_game").alias("play_id"), F.inline(seats))
        .where(F.col("runner_id").isNotNull()).distinct()
    )


def top_speeds(t: Tracking) -> DataFrame:
    """(play, player_position, runner_id) with ``path`` and ``max_speed``."""
    track = [*PLAY, "player_position"]
    frames = t.player_pos.where(F.col("player_position").isin(*RUNNERS))
    single = one_place(frames, track, "timestamp", *XY, CHUNK_MS, WINDOW_MS)
    moving = with_motion(single, track, "timestamp", *XY, WINDOW_MS)
    fast_enough = F.when(F.col(COVERED) >= LEAST_COVER_MS, F.col(SPEED))
    # a track is the same whoever ran it, so the person joins its one-row summary
    summary = trajectories(moving, track, "timestamp", *XY, max_speed=fast_enough)
    return summary.join(runner_ids(t), track)


def sprint_speed(t: Tracking) -> DataFrame:
    """(runner_id, sprint_speed, num_plays_measured), runners with enough plays."""
    low, high = SPEED_RANGE
    plays = plausible(top_speeds(t), {"path": (LEAST_PATH, None)}).where(
        (F.col("max_speed") > low) & (F.col("max_speed") < high))
    speeds = percentile(materialise(plays.select("runner_id", "max_speed")),
                        "max_speed", SPEED_SHARE, ["runner_id"])
    return min_sample(speeds, "n", LEAST_SAMPLE).select(
        "runner_id", F.col("value").alias("sprint_speed"),
        F.col("n").alias("num_plays_measured"))


def throw_times(t: Tracking) -> DataFrame:
    """(play, catcher_id, pop_time_sec) of every throw with a catch before the tag."""
    throws = t.game_events.where(F.col("event_code") == THROW).select(
        *PLAY, "play_per_game").distinct()
    catchers = t.game_info.where(F.col("catcher").isNotNull()).select(
        "game_str", "play_per_game", F.col("catcher").alias("catcher_id")).distinct()
    code, place = F.col("event_code"), F.col("player_position")
    caught = t.game_events.where(code == ACQUIRED).groupBy(*PLAY).agg(
        F.min(F.when(place == CATCHER, F.col("timestamp"))).alias("catch"),
        F.min(F.when(place.isin(*MIDDLE_INFIELD), F.col("timestamp"))).alias("tag"))
    return (
        throws.join(catchers, ["game_str", "play_per_game"])
        .select(*PLAY, "catcher_id").distinct()
        .join(caught.where(F.col("tag") > F.col("catch")), PLAY)
        .select(*PLAY, "catcher_id",
                seconds(F.col("tag") - F.col("catch")).alias("pop_time_sec"))
    )


def pop_time(t: Tracking) -> DataFrame:
    """(catcher_id, average_pop_time, total_throws), catchers with enough throws.

    Throws are one row per play and catcher, so counting rows counts plays.
    """
    usual = plausible(throw_times(t), {"pop_time_sec": POP_RANGE})
    means = usual.groupBy("catcher_id").agg(
        F.avg("pop_time_sec").alias("average_pop_time"), F.count("*").alias("total_throws"))
    return min_sample(means, "total_throws", LEAST_SAMPLE)


def game_count(t: Tracking) -> DataFrame:
    return t.game_info.agg(F.count_distinct("game_str").alias("total_games"))


def leaderboard(speeds: DataFrame) -> DataFrame:
    """Presentation order: fastest first."""
    return speeds.orderBy(F.desc("sprint_speed"), "runner_id")
