"""Pickoff attempts with the runner's lead and the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadline.functions.codes import OCCUPANTS, PICKOFF, PITCH, PLAY
from leadline.functions.scalars import any_of
from leadline.functions.states import occupied, runner_on_first_only
from leadline.operators.relational import attach_lookup, drop_keys
from leadline.operators.temporal import next_state
from leadline.plans.moments import BEFORE_PICKOFF, moment_before, released
from leadline.plans.people import sprint_speed
from leadline.session import materialise
from leadline.sources.tracking import Tracking


def plays_with(t: Tracking, *codes: int) -> DataFrame:
    """Distinct plays that have an event of one of the codes."""
    return t.game_events.where(F.col("event_code").isin(*codes)).select(*PLAY).distinct()


def pickoff_attempts(t: Tracking) -> DataFrame:
    """(play, runner_id): a pickoff throw, no pitch, and a runner on first only.

    One row per play; where copies of a play name several runners, the smallest id.
    """
    runners = t.game_info.where(runner_on_first_only()).groupBy(
        "game_str", F.col("play_per_game").alias("play_id")
    ).agg(F.min("first_baserunner").alias("runner_id"))
    tried = drop_keys(plays_with(t, PICKOFF), plays_with(t, PITCH), PLAY)
    return tried.join(runners, PLAY)


def pickoff_label(t: Tracking, attempts: DataFrame) -> DataFrame:
    """Add ``pickoff_result``: -1 no next play, 0 somebody is on base in it, 1 nobody is."""
    stayed = any_of(occupied(base) for base in OCCUPANTS.values())
    after = t.game_info.where(F.col("play_per_game").isNotNull()).groupBy(
        "game_str", F.col("play_per_game").alias("play_id")
    ).agg(F.min(F.when(stayed, 0).otherwise(1)).alias("result"))
    followed = next_state(attempts, after, ["game_str"], "play_id")
    return followed.withColumn(
        "pickoff_result", F.coalesce("next_result", F.lit(-1))).drop("next_result", "next_play_id")


def pickoff_set(t: Tracking, speeds: DataFrame | None = None,
                releases: DataFrame | None = None) -> DataFrame:
    """Labelled attempts with the kinematics 725 ms before release and sprint speed."""
    speeds = materialise(sprint_speed(t)) if speeds is None else speeds
    labelled = materialise(pickoff_label(t, pickoff_attempts(t)).where("pickoff_result <> -1"))
    targets = released(t, labelled, releases).join(labelled, PLAY).withColumn(
        "at", F.col("release_timestamp") - BEFORE_PICKOFF)
    moments = moment_before(t, targets, ties="early")
    return attach_lookup(
        moments.select(*PLAY, "runner_id", "lead_distance", "velocity", "acceleration", "jerk",
                       "pickoff_result"),
        speeds.select("runner_id", "sprint_speed"), "runner_id", "runner_id")
