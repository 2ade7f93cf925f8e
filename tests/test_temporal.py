"""Chunked operators against brute force, on time lines with gaps, ties and a long entity."""

import math
import random

import pytest
from pyspark.sql import functions as F

from leadline.operators import motion, temporal
from leadline.operators.chunks import chunk_of, spread

WIDTHS = [50, 173, 100_000]


def series(seed=1, ties=False):
    """Entity 0 has most of the rows; times run from below zero and have long gaps."""
    rng = random.Random(seed)
    rows = []
    for entity in (0, 0, 0, 0, 1, 2, 3):
        at = rng.randint(-400, 0)
        for _ in range(25):
            at += rng.choice([0, 1, 7, 20, 333] if ties else [1, 7, 20, 333])
            rows.append((entity, at, round(rng.uniform(-5, 5), 3), rng.randint(0, 9)))
    if not ties:
        rows = list({(e, t): (e, t, x, y) for e, t, x, y in rows}.values())
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "e int, t long, x double, y int").repartition(3)


@pytest.mark.parametrize("width", [7, *WIDTHS])
def test_trailing_first_and_span(spark, width):
    rows = series()
    got = temporal.trailing_first(frame(spark, rows), ["e"], "t", ["x", "t"], 40, width).collect()
    assert len(got) == len(rows)
    for r in got:
        first = min((t, x) for e, t, x, _ in rows if e == r.e and r.t - 40 <= t <= r.t)
        assert (r.first_t, r.first_x) == first


@pytest.mark.parametrize("width", WIDTHS)
def test_neighbours(spark, width):
    rows = series(2)
    before = temporal.previous_or_self(frame(spark, rows), ["e"], "t", ["x"], width).collect()
    after = temporal.next_value(frame(spark, rows), ["e"], "t", ["x"], width).collect()
    assert len(before) == len(after) == len(rows)
    for r in before:
        earlier = [(t, x) for e, t, x, _ in rows if e == r.e and t < r.t]
        assert r.prev_x == (max(earlier)[1] if earlier else r.x)
    for r in after:
        later = [(t, x) for e, t, x, _ in rows if e == r.e and t > r.t]
        assert r.next_x == (min(later)[1] if later else None)


@pytest.mark.parametrize("width", [7, 150, 400, 1000, 100_000])
def test_lookback_with_gaps_and_ties(spark, width):
    rows = series(3, ties=True)
    got = temporal.lookback(frame(spark, rows), ["e"], "t", ["x", "y"], [0, 100, 300], width)
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        for d in (0, 100, 300):
            seen = [(t, x, y) for e, t, x, y in rows if e == r.e and t <= r.t - d]
            back = r[f"back_{d}"]
            assert (tuple(back) if back else None) == (max(seen) if seen else None)


def test_halo_must_fit_into_a_chunk(spark):
    with pytest.raises(ValueError):
        spread(frame(spark, series()), "t", 200, 300)


@pytest.mark.parametrize("width", WIDTHS)
def test_asof_two_tables(spark, width):
    left, right = series(4, ties=True), series(5, ties=True)
    right = [r for r in right if r[0] != 2]
    got = temporal.asof(frame(spark, left).withColumnRenamed("x", "v"),
                        frame(spark, right), ["e"], "t", ["x", "y"], width).collect()
    assert len(got) == len(left)
    assert sorted((r.e, r.t, r.v) for r in got) == sorted((e, t, v) for e, t, v, _ in left)
    for r in got:
        seen = [(t, x, y) for e, t, x, y in right if e == r.e and t <= r.t]
        assert (tuple(r["asof"]) if r["asof"] else None) == (max(seen) if seen else None)


@pytest.mark.parametrize("ties", ["early", "late"])
@pytest.mark.parametrize("width", WIDTHS)
def test_nearest_and_samples(spark, ties, width):
    rows = series(6, ties=True)
    aims = [(0, 250), (1, 90), (2, -10_000), (3, 10_000), (9, 0)]
    targets = spark.createDataFrame(aims, "e int, at long")
    near = temporal.nearest(frame(spark, rows), targets, ["e"], "t", "at", ["x", "y"], width, ties)
    only = {r.e: tuple(r.near) for r in near.collect()}
    deltas = [10, 100]
    times = temporal.nearest_time(frame(spark, rows), targets, ["e"], "t", "at", width, ties)
    sent = temporal.nearest_time(frame(spark, rows), targets, ["e"], "t", "at", width, ties, 100)
    assert sorted(times.collect()) == sorted(sent.collect())
    got = temporal.samples_before(
        frame(spark, rows), times, ["e"], "t", "near_time", ["x", "y"], deltas, width)
    got = {r.e: r for r in got.collect()}
    assert set(got) == set(only) == {0, 1, 2, 3}
    sign = 1 if ties == "early" else -1
    for entity, at in aims[:4]:
        own = [(t, x, y) for e, t, x, y in rows if e == entity]
        want = min(own, key=lambda p: (abs(p[0] - at), sign * p[0], p[1], p[2]))
        assert tuple(got[entity].near) == only[entity] == want
        for d in deltas:
            seen = [p for p in own if p[0] <= want[0] - d]
            back = got[entity][f"back_{d}"]
            assert (tuple(back) if back else None) == (max(seen) if seen else None)


def test_nearest_tie_between_two_frames(spark):
    rows = frame(spark, [(0, 0, 1.0, 0), (0, 50, 2.0, 0)])
    targets = spark.createDataFrame([(0, 25)], "e int, at long")
    for ties, want in (("early", 0), ("late", 50)):
        found = temporal.nearest(rows, targets, ["e"], "t", "at", ["x"], 1000, ties).first()
        assert found.near.t == want


@pytest.mark.parametrize("width", [30, 500, 100_000])
def test_resample(spark, width):
    rows = series(7, ties=True)
    data = spark.createDataFrame(
        [(e // 2, e, t, x, y) for e, t, x, y in rows], "p int, e int, t long, x double, y int")
    got = temporal.resample(data, ["p"], ["e"], "t", ["x", "y"], 37, width).collect()
    want = set()
    for play in (0, 1):
        own = [r for r in rows if r[0] // 2 == play]
        lo, hi = min(r[1] for r in own), max(r[1] for r in own)
        for step in range(37):
            instant = lo + (hi - lo) * step / 36.0
            for entity in {r[0] for r in own}:
                seen = [(t, x, y) for e, t, x, y in own if e == entity and t <= instant]
                if seen:
                    want.add((play, entity, step, *max(seen)[1:]))
    assert len(got) == len(want)
    assert {(r.p, r.e, r.step, r.x, r.y) for r in got} == want


def test_resample_single_instant(spark):
    data = spark.createDataFrame([(0, 0, 5, 1.0)], "p int, e int, t long, x double")
    got = temporal.resample(data, ["p"], ["e"], "t", ["x"], 10, 100).collect()
    assert sorted(r.step for r in got) == list(range(10))


@pytest.mark.parametrize("width", [60, 500, 100_000])
def test_path_and_speed(spark, width):
    rows = series(8)
    data = frame(spark, rows).withColumn("y", F.col("y").cast("double"))
    paths = motion.path_length(data, ["e"], "t", "x", "y", width).collect()
    for r in paths:
        own = sorted((t, x, y) for e, t, x, y in rows if e == r.e)
        want = sum(math.dist(a[1:], b[1:]) for a, b in zip(own, own[1:]))
        assert r.path == pytest.approx(want)
        assert r.path >= math.dist(own[0][1:], own[-1][1:]) - 1e-9
    speeds = motion.trailing_speed(data, ["e"], "t", "x", "y", 50, width).collect()
    assert len(speeds) == len(rows)
    for r in speeds:
        first = min((t, x, y) for e, t, x, y in rows if e == r.e and r.t - 50 <= t <= r.t)
        assert r.covered == r.t - first[0]
        if r.covered:
            want = math.dist((r.x, r.y), first[1:]) / r.covered * 1000
            assert r.speed == pytest.approx(want)
        else:
            assert r.speed is None


def test_copies_and_same_instants_keep_the_smallest(spark):
    rows = [(0, 0, 0.0, 0), (0, 0, 0.0, 0), (0, 0, 9.0, 0), (0, 10, 3.0, 4), (0, 10, 3.0, 4)]
    data = frame(spark, rows).withColumn("y", F.col("y").cast("double"))
    assert motion.path_length(data, ["e"], "t", "x", "y", 1000).first().path == 5.0
    single = temporal.one_per_instant(frame(spark, rows), ["e"], "t", ["x", "y"]).collect()
    assert sorted((r.t, r.x) for r in single) == [(0, 0.0), (10, 3.0)]


def test_next_state_forms(spark):
    states = spark.createDataFrame(
        [("g", 1, "a"), ("g", 2, "b"), ("g", 5, "c"), ("h", 9, "d")], "g string, n int, s string")
    plus = temporal.next_state(states, states, ["g"], "n").collect()
    assert {(r.g, r.n): r.next_s for r in plus} == {
        ("g", 1): "b", ("g", 2): None, ("g", 5): None, ("h", 9): None}
    for width in (1, 3, 1000):
        lead = temporal.next_state(states, states, ["g"], "n", gaps=True, width=width).collect()
        assert {(r.g, r.n): (r.next_n, r.next_s) for r in lead} == {
            ("g", 1): (2, "b"), ("g", 2): (5, "c")}


def test_chunk_numbers_below_zero(spark):
    data = spark.createDataFrame([(-101,), (-100,), (-1,), (0,), (99,), (100,)], "t long")
    got = [r.c for r in data.select("t", chunk_of("t", 100).alias("c")).orderBy("t").collect()]
    assert got == [-2, -1, -1, 0, 0, 1]
