"""Lead profile of all plays, scenarios out of it, resampled and annotated frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadline.functions.codes import FRAME, PICKOFF, PITCH, PLAY, POSITIONS_END
from leadline.functions.states import ball_size, role, runner_on_first_only
from leadline.operators.ranking import quantile_table
from leadline.operators.relational import keep_keys
from leadline.operators.temporal import attach_to_series, resample, sync_frames
from leadline.plans.moments import (
    BEFORE_PICKOFF, BEFORE_PITCH, CHUNK_MS, NARROW_ROWS, XY, moment_before, released,
)
from leadline.session import materialise
from leadline.sources.tracking import Tracking

KINEMATIC = ["lead_distance", "velocity", "acceleration", "jerk"]

# Shares of the feature distributions that are used as leads.
SHARES = [0.11, 0.25, 0.27, 0.5, 0.55, 0.6, 0.75]

BALL = 0  # position code given to the ball among the tracks of a play


def single_runner_plays(t: Tracking) -> DataFrame:
    return t.game_info.where(runner_on_first_only() & F.col("play_per_game").isNotNull()).select(
        "game_str", F.col("play_per_game").alias("play_id")).distinct()


def play_type(t: Tracking, plays: DataFrame | None = None) -> DataFrame:
    """(play, play_type): the smaller of the labels, so a pickoff wins over a pitch."""
    code = F.col("event_code")
    events = t.game_events.where(code.isin(PITCH, PICKOFF))
    kinds = events.groupBy(*PLAY).agg(
        F.min(F.when(code == PITCH, "pitch").when(code == PICKOFF, "pickoff")).alias("play_type"))
    return kinds if plays is None else keep_keys(kinds, plays, PLAY)


def lead_profile(t: Tracking, releases: DataFrame | None = None) -> DataFrame:
    """(play, play_type, kinematics) of every play with a runner on first only."""
    kinds = materialise(play_type(t, single_runner_plays(t)))
    offset = F.when(F.col("play_type") == "pitch", BEFORE_PITCH).otherwise(BEFORE_PICKOFF)
    targets = released(t, kinds, releases).join(kinds, PLAY).withColumn(
        "at", F.col("release_timestamp") - offset)
    return moment_before(t, targets, ties="early", form="midpoint").select(
        *PLAY, "play_type", *KINEMATIC)


def lead_scenarios(leads: DataFrame, shares=tuple(SHARES)) -> DataFrame:
    """One row of kinematic features per share; give a stored table, it is read thrice."""
    table = quantile_table(leads, KINEMATIC, shares)
    return table.groupBy("share").agg(*[
        F.max(F.when(F.col("feature") == c, F.col("value"))).alias(c) for c in KINEMATIC])


def frames_for(plays: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames of the listed plays, in one pass for all of them."""
    keys = materialise(plays.select(*PLAY).distinct())
    return attach_to_series(frames, keys, PLAY, "timestamp", CHUNK_MS, NARROW_ROWS)


def synced_frames(t: Tracking) -> DataFrame:
    """Player frames with the ball of the same instant, where there is one."""
    players = t.player_pos.where(F.col("player_position") < POSITIONS_END)
    return sync_frames(players, t.ball_pos, FRAME, "left")


def annotate_frames(t: Tracking) -> DataFrame:
    return synced_frames(t).withColumns({
        "role": role(F.col("player_position")),
        "ball_size": ball_size(F.col("ball_position_z")),
    })


def resample_play(t: Tracking, plays: DataFrame | None = None, steps: int = 100) -> DataFrame:
    """Evenly spaced instants of each play with everybody's last known place.

    The ball is one more track, with position code 0, known at instants at which some
    player was tracked; only it has a height.
    """
    players, ball = t.player_pos, t.ball_pos
    if plays is not None:
        players, ball = frames_for(plays, players), frames_for(plays, ball)
    players = players.where(F.col("player_position") < POSITIONS_END)
    seen = keep_keys(ball.dropna().hint("merge"), players, FRAME)
    series = players.select(
        *PLAY, "player_position", "timestamp", *XY, F.lit(None).cast("double").alias("z")
    ).unionByName(seen.select(
        *PLAY, F.lit(BALL).alias("player_position"), "timestamp",
        F.col("ball_position_x").alias("field_x"), F.col("ball_position_y").alias("field_y"),
        F.col("ball_position_z").alias("z")))
    return resample(series, PLAY, ["player_position"], "timestamp", [*XY, "z"], steps, CHUNK_MS)
