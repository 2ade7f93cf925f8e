"""Attempts to steal second base with the runner's lead and the outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadline.functions.codes import (
    DEFLECTION, IN_PLAY, PICKOFF, PITCH, PLAY, RUNNER_FIRST, SECOND_BASE, THROW,
)
from leadline.functions.scalars import distance, has_features
from leadline.functions.states import empty, occupied, runner_on_first_only
from leadline.operators.relational import attach_lookup, drop_keys, exists_flag, keep_keys
from leadline.operators.temporal import next_state
from leadline.plans.moments import BEFORE_PITCH, moment_before, released
from leadline.plans.people import pop_time, sprint_speed
from leadline.plans.pickoffs import plays_with
from leadline.session import materialise
from leadline.sources.tracking import Tracking

# Fixed values, in feet.
NEAR_SECOND = 45
PASSED_BALL_Y = -5

STEAL_FEATURES = ["sprint_speed", "average_pop_time", "lead_distance", "velocity", "acceleration"]


def plays_near_second(t: Tracking, feet: float = NEAR_SECOND) -> DataFrame:
    """Distinct plays in which the runner from first came near second base."""
    near = distance(F.col("field_x"), F.col("field_y"), SECOND_BASE) < F.lit(float(feet))
    return t.player_pos.where((F.col("player_position") == RUNNER_FIRST) & near).select(
        *PLAY).distinct()


def passed_balls(t: Tracking) -> DataFrame:
    return t.ball_pos.where(F.col("ball_position_y") < PASSED_BALL_Y).select(*PLAY).distinct()


def steal_candidates(t: Tracking) -> DataFrame:
    """Plays with a runner on first only, a pitch and a runner who went for second."""
    info = t.game_info.where(
        runner_on_first_only() & F.col("play_per_game").isNotNull() & F.col("catcher").isNotNull()
    ).select("game_str", "play_per_game", F.col("first_baserunner").alias("runner_id"),
             F.col("catcher").alias("catcher_id"), "top_bottom_inning").distinct()
    numbers = t.game_events.select(*PLAY, "play_per_game").distinct()
    plays = info.join(numbers, ["game_str", "play_per_game"])
    pitched = keep_keys(plays, plays_with(t, PITCH), PLAY)
    undisturbed = drop_keys(pitched, plays_with(t, IN_PLAY, PICKOFF, DEFLECTION), PLAY)
    clean = drop_keys(undisturbed, passed_balls(t), PLAY)
    return keep_keys(clean, plays_near_second(t), PLAY)


def steal_outcome(t: Tracking, candidates: DataFrame | None = None) -> DataFrame:
    """Add ``outcome``: 0 when the next play has a runner on second or third, else 1.

    First base must be empty in the next play, which is in the same half-inning or, if
    the half changed, follows a throw.
    """
    candidates = steal_candidates(t) if candidates is None else candidates
    states = t.game_info.where(F.col("play_per_game").isNotNull()).select(
        "game_str", "play_per_game", "first_baserunner", "second_baserunner",
        "third_baserunner", "top_bottom_inning").distinct()
    followed = next_state(candidates, states, ["game_str"], "play_per_game", gaps=True)
    thrown = exists_flag(followed, plays_with(t, THROW), PLAY, "thrown")
    half, next_half = F.col("top_bottom_inning"), F.col("next_top_bottom_inning")
    safe = occupied("next_second_baserunner") | occupied("next_third_baserunner")
    return (
        thrown.where(empty("next_first_baserunner"))
        .where((half == next_half) | ((half != next_half) & F.col("thrown")))
        .select("game_str", "play_per_game", "play_id", "runner_id", "catcher_id",
                F.when(safe, 0).otherwise(1).alias("outcome")).distinct()
    )


def steal_set(t: Tracking, speeds: DataFrame | None = None,
              pops: DataFrame | None = None, releases: DataFrame | None = None) -> DataFrame:
    """Outcomes with the kinematics 1250 ms before release, sprint speed and pop time."""
    speeds = materialise(sprint_speed(t)) if speeds is None else speeds
    pops = materialise(pop_time(t)) if pops is None else pops
    outcomes = materialise(steal_outcome(t))
    targets = released(t, outcomes, releases).withColumn(
        "at", F.col("release_timestamp") - BEFORE_PITCH)
    moments = moment_before(t, targets, ties="late").select(
        *PLAY, "lead_distance", "velocity", "acceleration", "jerk")
    rows = outcomes.join(moments, PLAY, "left").where(has_features(["lead_distance"]))
    rows = attach_lookup(rows, speeds.select("runner_id", "sprint_speed"),
                         "runner_id", "runner_id")
    rows = attach_lookup(rows, pops.select("catcher_id", "average_pop_time"),
                         "catcher_id", "catcher_id")
    return rows.where(has_features(["lead_distance"], ["sprint_speed", "average_pop_time"])).drop(
        "play_per_game")
