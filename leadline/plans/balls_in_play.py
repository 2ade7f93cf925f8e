"""Balls in play with a runner on first: results, end positions, leads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadline.functions.codes import (
    BASES, BATTER, END_OF_PLAY, FRAME, IN_PLAY, PLAY, RUNNER_FIRST, RUNNER_SECOND, RUNNER_THIRD,
)
from leadline.functions.scalars import any_of, pad3, within
from leadline.functions.states import base_reached, base_state, runner_on_first_only
from leadline.operators.relational import attach_lookup, exclude, first_per, keep_keys, top1
from leadline.operators.temporal import attach_to_series, next_state
from leadline.plans.moments import (
    BEFORE_PITCH, CHUNK_MS, NARROW_ROWS, XY, moment_before, released,
)
from leadline.plans.people import sprint_speed
from leadline.plans.pickoffs import plays_with
from leadline.session import materialise
from leadline.sources.tracking import Tracking

# Feet from the base; base states left out, of all sets and of outs.
AT_BASE = 10
LOADED = ["111"]
NOT_FOR_OUTS = ["110", "101", "011"]
RESULT_SETS = ["Out", "1B", "2B"]

BIP_FEATURES = ["lead_distance", "velocity", "acceleration", "sprint_speed"]

AT_BAT = ["game_str", "top_bottom_inning", "at_bat"]


def last_row_of_at_bat(info: DataFrame) -> DataFrame:
    """Latest play per at-bat; ties by batter, runner, then the other bases."""
    return top1(info.where(F.col("at_bat").isNotNull()), AT_BAT, [
        F.desc_nulls_last("play_per_game"), *[
            F.asc_nulls_last(c) for c in ("batter", "first_baserunner", "second_baserunner",
                                          "third_baserunner")]])


def bip_plays(t: Tracking) -> DataFrame:
    """At-bats with a ball in play and a runner on first only, and the state after."""
    info = t.game_info.withColumn("play_id", F.col("play_per_game"))
    played = t.game_events.select(*PLAY).distinct()
    current = last_row_of_at_bat(
        keep_keys(info.where(runner_on_first_only()), plays_with(t, IN_PLAY), PLAY)
    ).select("game_str", "play_id", "top_bottom_inning", "at_bat", "play_per_game", "batter",
             "first_baserunner")
    after = last_row_of_at_bat(keep_keys(info, played, PLAY)).select(
        *AT_BAT, F.col("play_per_game").alias("play"), F.col("first_baserunner").alias("first"),
        F.col("second_baserunner").alias("second"), F.col("third_baserunner").alias("third"))
    return next_state(current, after, ["game_str", "top_bottom_inning"], "at_bat").where(
        F.col("next_at_bat").isNotNull()).drop("next_at_bat")


def bip_results(plays: DataFrame) -> DataFrame:
    """Add the results of batter and runner and the three-digit base state."""
    after = [F.col(c) for c in ("next_first", "next_second", "next_third")]
    return plays.withColumns({
        "batter_result": base_reached(F.col("batter"), *after, "Out"),
        "baserunner_result": base_reached(F.col("first_baserunner"), *after, "Inconclusive"),
    }).withColumn("base_state", base_state(F.col("batter_result"), F.col("baserunner_result"))).drop(
        "next_play", "next_first", "next_second", "next_third")


def end_positions(t: Tracking, position: int) -> DataFrame:
    """(play, x, y) of a position in the frame of the last end-of-play event."""
    ends = materialise(t.game_events.where(F.col("event_code") == END_OF_PLAY).groupBy(*PLAY).agg(
        F.collect_set("timestamp").alias("_ends")))
    frames = t.player_pos.where(F.col("player_position") == position).select(*FRAME, *XY)
    # the few ends of a play go to its frames, which stay
    there = attach_to_series(frames, ends, PLAY, "timestamp", CHUNK_MS, NARROW_ROWS).where(
        F.array_contains("_ends", F.col("timestamp")))
    # greatest time, then smallest coordinates
    latest = F.max(F.struct("timestamp", (-F.col("field_x")).alias("x"),
                            (-F.col("field_y")).alias("y")))
    return there.groupBy(*PLAY).agg(latest.alias("e")).select(
        *PLAY, (-F.col("e.x")).alias("x"), (-F.col("e.y")).alias("y"))


def bip_end_positions(t: Tracking, results: DataFrame) -> DataFrame:
    """Add where batter and runner were at the end of the play.

    Only position 11 is followed, while the result asks for the position of the base
    reached, so a runner found on second or third has no end position.
    """
    batter = end_positions(t, BATTER).withColumnsRenamed({"x": "batter_end_x", "y": "batter_end_y"})
    runner = end_positions(t, RUNNER_FIRST).withColumn(
        "end_position", F.lit(RUNNER_FIRST)).withColumnsRenamed(
        {"x": "runner_end_x", "y": "runner_end_y"})
    wanted = (
        F.when(F.col("baserunner_result") == "1B", RUNNER_FIRST)
        .when(F.col("baserunner_result") == "2B", RUNNER_SECOND)
        .when(F.col("baserunner_result") == "3B", RUNNER_THIRD)
        .otherwise(-1)
    )
    return (
        results.withColumn("end_position", wanted)
        .join(batter, PLAY, "left").join(runner, [*PLAY, "end_position"], "left")
        .drop("end_position")
    )


def bip_validated(t: Tracking, plays: DataFrame | None = None) -> DataFrame:
    """Results whose batter ended near the base the next state puts them on."""
    results = bip_results(bip_plays(t) if plays is None else plays)
    result = F.col("batter_result")
    there = any_of(
        (result == name) & within(F.col("batter_end_x"), F.col("batter_end_y"), base, AT_BASE)
        for name, base in BASES.items())
    return bip_end_positions(t, results).where((result == "Out") | there)


def bip_set(t: Tracking, speeds: DataFrame | None = None,
            releases: DataFrame | None = None) -> DataFrame:
    """Validated results with the kinematics 1250 ms before release and sprint speed."""
    speeds = materialise(sprint_speed(t)) if speeds is None else speeds
    valid = materialise(bip_validated(t))
    targets = released(t, valid.select(*PLAY).distinct(), releases).withColumn(
        "at", F.col("release_timestamp") - BEFORE_PITCH)
    moments = moment_before(t, targets, ties="early", undefined="zero").select(
        *PLAY, "lead_distance", "velocity", "acceleration", "jerk")
    single = first_per(valid, [*PLAY, "at_bat", "play_per_game"],
                       ["top_bottom_inning", "batter", "first_baserunner"])
    rows = exclude(single.join(moments, PLAY), "base_state", LOADED)
    rows = rows.where(F.col("lead_distance").isNotNull()).withColumn(
        "base_state", pad3(F.col("base_state")))
    return attach_lookup(rows, speeds.select("runner_id", "sprint_speed"),
                         "first_baserunner", "runner_id")


def training_rows(bip: DataFrame, result: str) -> DataFrame:
    """The rows one result's model is trained on; give a stored set."""
    rows = bip.where(F.col("batter_result") == result)
    return exclude(rows, "base_state", NOT_FOR_OUTS) if result == "Out" else rows
