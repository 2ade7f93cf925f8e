"""Pipelines on hand-made plays with known answers."""

import pytest
from pyspark.sql import functions as F

from leadline.functions.codes import BATTER
from leadline.plans import balls_in_play, leads, moments, people, pickoffs, steals
from leadline.sources.tracking import load_tracking, require_columns, require_one_game
from plays import FIRST, ball, event, info, make, pitcher, runner


def steady(feet_per_second, start=10.0):
    return lambda t: start + feet_per_second * t / 1000


# -- release and kinematics -----------------------------------------------------------

def test_constant_velocity_has_no_acceleration(spark):
    t = make(spark, [info(1)], [], runner(1, steady(4)) + pitcher(1), ball(1))
    rows = moments.kinematics(moments.runner_lookback(t)).where("near.timestamp >= 300").collect()
    assert len(rows) == 75
    for r in rows:
        assert r.velocity == pytest.approx(4)
        assert abs(r.acceleration) < 1e-6 and abs(r.jerk) < 1e-4


@pytest.mark.parametrize("undefined,velocity", [("null", None), ("zero", 0.0)])
def test_undefined_velocity(spark, undefined, velocity):
    t = make(spark, [info(1)], [], runner(1, steady(4)), [])
    first = moments.kinematics(moments.runner_lookback(t), undefined=undefined).where(
        "near.timestamp = 0").first()
    assert first.velocity == velocity and first.acceleration is None and first.jerk is None


def test_gap_longer_than_a_lag(spark):
    times = [0, 50, 1000, 1050, 1100]
    t = make(spark, [info(1)], [], runner(1, steady(2), times), [])
    row = moments.kinematics(moments.runner_lookback(t)).where("near.timestamp = 1100").first()
    assert row.back_100.timestamp == 1000
    assert row.back_200.timestamp == row.back_300.timestamp == 50
    assert row.velocity == pytest.approx(2) and row.jerk is None  # two samples coincide
    # every row has all samples or is dropped in the midpoint form
    middle = moments.kinematics(moments.runner_lookback(t), "midpoint").collect()
    assert {r.near.timestamp for r in middle} == {1000, 1050, 1100}


@pytest.mark.parametrize("bound", [0, 500_000])
def test_release_of_listed_plays_whatever_the_bound(spark, monkeypatch, bound):
    monkeypatch.setattr(moments, "NARROW_ROWS", bound)
    t = make(spark, [info(1), info(2)], [], pitcher(1) + pitcher(2), ball(1) + ball(2))
    only = spark.createDataFrame([("G", 2), ("G", 2)], "game_str string, play_id int")
    assert [r.play_id for r in moments.release_time(t, only).collect()] == [2]


def test_release_with_copies_contradictions_and_no_release(spark):
    players = pitcher(1) + pitcher(1) + pitcher(2) + pitcher(3) + pitcher(4)
    # play 2: at 500 ms one of two ball rows is away from the pitcher
    odd = [("G", 2, 500, 30.0, 60.0, 3.0)]
    # play 3: the contradiction comes after the release and must not matter
    late = [("G", 3, 3000, 0.0, 60.0, 3.0)]
    held = [("G", 4, t, 0.0, 60.0, 3.0) for t in range(0, 4001, 50)]
    t = make(spark, [], [], players, ball(1) * 3 + ball(2) + odd + ball(3) + late + held)
    got = {r.play_id: r.release_timestamp for r in moments.release_time(t).collect()}
    assert got == {1: 2000, 2: 500, 3: 2000}
    only = t.game_info.sparkSession.createDataFrame([("G", 3)], "game_str string, play_id int")
    assert [r.play_id for r in moments.release_time(t, only).collect()] == [3]


def test_unsynchronised_clocks_have_no_release(spark):
    t = make(spark, [], [], pitcher(1, range(7, 4000, 50)), ball(1))
    assert moments.release_time(t).count() == 0


# -- people ---------------------------------------------------------------------------

def runs(play, speed, **kw):
    return runner(play, steady(speed), range(0, 4001, 50), **kw)


def test_sprint_speed(spark):
    infos = [info(p, first="R1") for p in (1, 2, 3, 4)] + [
        info(5, first="NA", second="R1"), info(6, first="R2"), info(7, first="NA")]
    infos += infos[:2]  # repeated rows
    players = (runs(1, 24) + runs(2, 26) + runs(3, 28) + runs(4, 45)  # play 4 is too fast
               + runs(5, 30, position=12) + runs(6, 25) + runs(7, 25))
    t = make(spark, infos, [], players + players[:50] * 5)
    got = people.sprint_speed(t).collect()
    # four plausible plays of R1 (three from first, one from second), one of R2
    assert [(r.runner_id, r.num_plays_measured) for r in got] == [("R1", 4)]
    assert got[0].sprint_speed == pytest.approx(28.8)  # 24 26 28 30 at 0.8


def test_short_windows_do_not_count(spark):
    t = make(spark, [info(1)], [], runner(1, steady(30, 0), range(0, 701, 50)))
    assert people.top_speeds(t).first().max_speed is None


def test_pop_time(spark):
    events = []
    for play, tag in ((1, 3900), (2, 4000), (3, 4100), (4, 5500), (5, 2000)):
        events += [event(play, 2000, 2, 2), event(play, 2500, 2, 3), event(play, tag, 4, 2),
                   event(play, tag + 500, 6, 2)]
    t = make(spark, [info(p) for p in range(1, 6)] * 2, events)
    assert people.throw_times(t).count() == 4  # play 5: tag not after the catch
    got = people.pop_time(t).collect()         # play 4 takes too long
    assert [(r.catcher_id, r.total_throws) for r in got] == [("C1", 3)]
    assert got[0].average_pop_time == pytest.approx(2.0)
    none = make(spark, [info(p, catcher="NA") for p in range(1, 6)], events)
    assert people.pop_time(none).count() == 0


# -- pickoffs ---------------------------------------------------------------------------

def test_pickoff_labels(spark):
    infos = [info(1), info(2, first="NA"),            # picked off
             info(3), info(4),                        # still there
             info(6),                                 # nothing is numbered 7
             info(8), info(9, first=None, third="X"),  # null, and somebody on third
             info(10, second="R9"),                   # not alone
             info(12), info(None)]
    events = [event(p, 2000, 1, 6) for p in (1, 3, 6, 8, 10, 12)]
    events += [event(12, 1000, 1, 1), event(3, 2100, 1, 6)]  # 12 has a pitch, 3 two throws
    t = make(spark, infos, events)
    got = pickoffs.pickoff_label(t, pickoffs.pickoff_attempts(t)).collect()
    assert {r.play_id: r.pickoff_result for r in got} == {1: 1, 3: 0, 6: -1, 8: 0}


def test_pickoff_set_takes_the_early_frame(spark):
    infos = [info(1), info(2, first="NA")]
    players = runner(1, lambda t: t / 100) + pitcher(1)
    t = make(spark, infos, [event(1, 2000, 1, 6)], players, ball(1, released=2000))
    row = pickoffs.pickoff_set(t).first()
    assert row.lead_distance == pytest.approx(12.5)  # 1275 lies between 1250 and 1300
    assert row.pickoff_result == 1 and row.sprint_speed is None


# -- steals -----------------------------------------------------------------------------

def steal(play, **kw):
    events = [event(play, 2000, 1, 1)]
    players = runner(play, lambda t: 10 + max(0, t - 2000) * 0.03) + pitcher(play)
    return events, players, ball(play, **kw)


def steal_case(spark, infos, extra=(), **kw):
    events, players, balls = steal(1, **kw)
    t = make(spark, infos, events + list(extra), players, balls)
    return [(r.play_id, r.outcome) for r in steals.steal_outcome(t).collect()]


def test_steal_outcomes(spark):
    assert steal_case(spark, [info(1), info(4, first="NA", second="R1")]) == [(1, 0)]
    assert steal_case(spark, [info(1), info(2, first=None)]) == [(1, 1)]
    assert steal_case(spark, [info(1), info(2)]) == []          # still on first
    assert steal_case(spark, [info(1)]) == []                   # no next play
    assert steal_case(spark, [info(1, catcher="NA"), info(2, first="NA")]) == []


def test_steal_half_inning(spark):
    infos = [info(1), info(2, half="bottom", first="NA")]
    assert steal_case(spark, infos) == []
    assert steal_case(spark, infos, [event(1, 3000, 2, 3)]) == [(1, 1)]


@pytest.mark.parametrize("code", [4, 6, 10])
def test_steal_is_spoiled_by(spark, code):
    infos = [info(1), info(2, first="NA")]
    assert steal_case(spark, infos, [event(1, 2100, 1, code)]) == []


def test_steal_passed_ball(spark):
    assert steal_case(spark, [info(1), info(2, first="NA")], low=-6.0) == []


def test_steal_set_needs_speed_or_pop_time_and_prefers_the_late_frame(spark):
    events, players, balls = steal(1, released=2025)
    infos = [info(1), info(2, first="NA")]
    t = make(spark, infos, events, players, balls)
    assert steals.steal_set(t).count() == 0
    speeds = spark.createDataFrame([("R1", 27.0)], "runner_id string, sprint_speed double")
    row = steals.steal_set(t, speeds).first()
    assert (row.outcome, row.sprint_speed, row.average_pop_time) == (1, 27.0, None)
    # released in the frame at 2050: 800 ms is a frame, so no tie; see the target itself
    targets = moments.release_time(t).withColumn("at", F.lit(825).cast("bigint"))
    late = moments.moment_before(t, targets, ties="late").first()
    assert late.near.timestamp == 850


# -- balls in play ----------------------------------------------------------------------

def bip(spark, after, end=(FIRST, FIRST), batter="B1"):
    frames = [("G", 1, t, BATTER, *(end if t >= 3000 else (0.0, 0.0))) for t in range(0, 4001, 50)]
    events = [event(1, 2000, 1, 1), event(1, 2400, 10, 4), event(1, 3950, 255, 5),
              event(2, 0, 255, 5)]
    return make(spark, [info(1, batter=batter), after], events,
                frames + runner(1, steady(1)) + pitcher(1), ball(1))


@pytest.mark.parametrize("after,end,result,state", [
    (dict(first="B1", second="R1"), (FIRST, FIRST), "1B", "110"),
    (dict(first="B1", third="R1"), (FIRST, FIRST), "1B", "101"),
    (dict(first="NA", second="B1", third="R1"), (0.0, 120.0), "2B", "011"),
    (dict(first="NA"), (0.0, 0.0), "Out", "000"),
    (dict(first=None, third="R1"), (0.0, 0.0), "Out", "001"),
])
def test_results_of_balls_in_play(spark, after, end, result, state):
    rows = balls_in_play.bip_validated(bip(spark, info(2, **after), end)).collect()
    assert [(r.batter_result, r.base_state) for r in rows] == [(result, state)]


def test_batter_far_from_the_base_is_dropped(spark):
    t = bip(spark, info(2, first="B1"), end=(0.0, 0.0))
    assert balls_in_play.bip_plays(t).count() == 1
    assert balls_in_play.bip_validated(t).count() == 0


def test_unknown_batter_is_out(spark):
    t = bip(spark, info(2, first="NA"), batter="NA")
    row = balls_in_play.bip_results(balls_in_play.bip_plays(t)).first()
    assert (row.batter_result, row.baserunner_result) == ("Out", "Inconclusive")


def test_at_bat_that_is_no_number_has_no_successor(spark):
    t = bip(spark, info(2, at_bat="2.0", first="B1"))
    assert balls_in_play.bip_plays(t).count() == 0


def test_runner_end_position_only_on_first(spark):
    held = bip(spark, info(2, first="R1"))
    assert balls_in_play.bip_validated(held).first().runner_end_x is not None
    moved = bip(spark, info(2, first="NA", second="R1"))
    assert balls_in_play.bip_validated(moved).first().runner_end_x is None


def test_bip_set_and_training_rows(spark):
    t = bip(spark, info(2, first="NA"))
    rows = balls_in_play.bip_set(t)
    assert rows.first().velocity == pytest.approx(1)
    assert balls_in_play.training_rows(rows, "Out").count() == 1
    assert balls_in_play.training_rows(rows, "1B").count() == 0


# -- leads ------------------------------------------------------------------------------

def test_pickoff_wins_over_pitch(spark):
    t = make(spark, [info(1), info(2), info(3, second="X")],
             [event(1, 0, 1, 1), event(1, 5, 1, 6), event(2, 0, 1, 1), event(3, 0, 1, 1)])
    kinds = leads.play_type(t, leads.single_runner_plays(t)).collect()
    assert {r.play_id: r.play_type for r in kinds} == {1: "pickoff", 2: "pitch"}


def test_lead_profile_drops_plays_without_look_back(spark):
    short = runner(2, steady(1), range(700, 4001, 50))
    t = make(spark, [info(1), info(2)], [event(1, 2000, 1, 1), event(2, 2000, 1, 1)],
             runner(1, steady(1)) + short + pitcher(1) + pitcher(2), ball(1) + ball(2))
    rows = leads.lead_profile(t).collect()
    assert [r.play_id for r in rows] == [1]
    assert rows[0].lead_distance == pytest.approx(10.75) and rows[0].play_type == "pitch"


def test_resample_ignores_others_and_unseen_ball(spark):
    players = runner(1, steady(1)) + [("G", 1, 0, 14, 0.0, 0.0)]
    lonely = [("G", 1, 25, 1.0, 1.0, 1.0)]  # no player frame at this instant
    t = make(spark, [info(1)], [], players, lonely + ball(1, times=range(2000, 4001, 50)))
    rows = leads.resample_play(t, steps=5).collect()
    assert {r.player_position for r in rows} == {0, 11}
    assert sorted(r.step for r in rows if r.player_position == 0) == [2, 3, 4]


def test_annotations(spark):
    t = make(spark, [], [], [("G", 1, 0, 11, 0.0, 0.0), ("G", 1, 50, 3, 0.0, 0.0)],
             [("G", 1, 0, 0.0, 0.0, 5.0)])
    rows = {r.player_position: r for r in leads.annotate_frames(t).collect()}
    assert (rows[11].role, rows[11].ball_size) == ("runner", 40.0)
    assert (rows[3].role, rows[3].ball_size) == ("fielder", 0.0)


# -- contracts --------------------------------------------------------------------------

def test_contracts(spark, tmp_path):
    t = make(spark, [info(1), info(2, game="H")], [event(1, 0, 1, 1)])
    with pytest.raises(ValueError, match="missing columns: nope"):
        require_columns(t.game_info, ["game_str", "nope"])
    one = t.game_info.where("game_str = 'G'")
    assert require_one_game(one).count() == 1
    with pytest.raises(Exception, match="more than one game"):
        require_one_game(t.game_info).collect()


def test_load_turns_markers_into_nulls(spark, tmp_path):
    from leadline.sources.tracking import RAW
    raw = dict(game_info=[info(1, at_bat="x1", first="NA")], game_events=[], player_pos=[],
               ball_pos=[])
    for name, rows in raw.items():
        spark.createDataFrame(rows, RAW[name]).write.parquet(f"{tmp_path}/{name}")
    row = load_tracking(spark, str(tmp_path)).game_info.first()
    assert row.at_bat is None and row.first_baserunner is None and row.batter == "B1"
