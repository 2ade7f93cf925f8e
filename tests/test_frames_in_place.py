"""Frames are never broadcast, and those that lie together by play are not moved again."""

import re

import pytest
from pyspark.sql import functions as F

from leadline.checks import fixture
from leadline.functions.codes import FRAME, PLAY
from leadline.operators import motion, temporal
from leadline.plans import leads, moments

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_streams_are_merged_whatever_their_estimated_size(spark, how):
    a = spark.range(100).selectExpr("id % 5 AS e", "id AS t", "id AS x")
    b = spark.range(50, 150).selectExpr("id % 5 AS e", "id AS t", "-id AS y")
    got = temporal.sync_frames(a, b, ["e", "t"], how)
    assert "SortMergeJoin" in plan(got) and "Broadcast" not in plan(got)
    assert got.count() == (50 if how == "inner" else 100) and got.where("y = -x").count() == 50


@pytest.mark.parametrize("rows", [
    lambda t: temporal.sync_frames(t.player_pos, t.ball_pos, FRAME).groupBy(*PLAY).count(),
    lambda t: leads.annotate_frames(t).groupBy(*PLAY).agg(F.sum("ball_size")),
    lambda t: moments.kinematics(moments.runner_lookback(t)).groupBy(*PLAY).agg(F.max("jerk")),
    lambda t: motion.trailing_speed(moments.runner_on_first_frames(t), PLAY, "timestamp",
                                    *moments.XY, 1000, 1500).groupBy(*PLAY).agg(F.max("speed")),
    lambda t: leads.resample_play(t).groupBy(*PLAY).count()])
def test_frames_of_a_play_stay_where_they_are_made(spark, rows):
    text = plan(rows(fixture.derived(spark, SF)))
    assert "REPARTITION_BY_NUM" in text and "ENSURE_REQUIREMENTS" not in text
    assert not re.search("Broadcast(Hash|NestedLoop)Join", text)


def test_every_frame_is_made_once(spark):
    t = fixture.derived(spark, SF)
    keys = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey")
    live = keys.where("(o_orderkey % 50 + 1) % 2 = 1")
    n, batting = live.count(), live.where("(o_orderkey div 2) % 4 = 3").count()
    counts = {r["player_position"]: r["count"] for r in
              t.player_pos.groupBy("player_position").count().collect()}
    assert counts == {1: 80 * n, 11: 80 * n, 10: 80 * batting} and t.ball_pos.count() == 80 * n


def test_places_of_an_instant(spark):
    """Nulls, copies and contradictions: the smallest struct of the instant counts, as before."""
    rows = [(1, 0, 3.0, 1.0), (1, 0, 2.0, 9.0), (1, 0, 2.0, 9.0), (1, 5, None, 4.0), (1, 5, 0.0, 0.0),
            (2, 5, float("nan"), 1.0), (2, 5, 7.0, None), (None, 5, 1.0, 1.0), (1, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "e int, t long, x double, y double")
    got = motion.one_place(df, ["e"], "t", "x", "y", 100, 0).select("e", "t", "x", "y")
    want = df.where("t IS NOT NULL").groupBy("e", "t").agg(F.min(F.struct("x", "y")).alias("p")).select(
        "e", "t", "p.*")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
