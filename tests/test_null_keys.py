"""Null keys and null groups, at several widths and ranges, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadline.operators import ranking, relational, temporal

WIDTHS = [7, 50, 173, 100_000]


def series(seed=21):
    """A third of the rows has no entity."""
    rng = random.Random(seed)
    rows = []
    for entity in (None, 1, 2):
        at = rng.randint(-200, 0)
        for _ in range(40):
            at += rng.choice([1, 7, 20, 333])
            rows.append((entity, at, round(rng.uniform(-5, 5), 3)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "e int, t long, x double").repartition(3)


@pytest.mark.parametrize("width", WIDTHS)
def test_null_is_an_entity_of_windows(spark, width):
    rows = series()
    got = temporal.trailing_first(frame(spark, rows), ["e"], "t", ["x"], 40, width)
    found = {(r.e, r.t): r.first_x for r in got.collect()}
    assert found == {(e, t): min((u, x) for f, u, x in rows if f == e and t - 40 <= u <= t)[1]
                     for e, t, _ in rows}
    before = temporal.previous_or_self(frame(spark, rows), ["e"], "t", ["x"], width)
    assert {(r.e, r.t): r.prev_x for r in before.collect()} == {
        (e, t): max([(u, y) for f, u, y in rows if f == e and u < t], default=(t, x))[1]
        for e, t, x in rows}


@pytest.mark.parametrize("width", WIDTHS)
def test_null_sees_nothing_in_look_backs(spark, width):
    rows = series(22)
    got = temporal.lookback(frame(spark, rows), ["e"], "t", ["x"], [0, 40], width).collect()
    assert len(got) == len(rows)
    for r in got:
        for d in (0, 40):
            seen = [(t, x) for e, t, x in rows if e is not None and e == r.e and t <= r.t - d]
            assert (tuple(r[f"back_{d}"]) if r[f"back_{d}"] else None) == max(seen, default=None)


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_null_groups_of_ranks(spark, ranges):
    rng = random.Random(23)
    rows = [(g, rng.randint(0, 1), round(rng.gauss(0, 1), 1) + 0.0, rng.random())
            for g in (None, "a", "b") for _ in range(60)]
    df = spark.createDataFrame(rows, "g string, l int, s double, z double")
    cut = ranking.percentile(df, "s", 0.8, ["g"], ranges).collect()
    assert {r.g: r.value for r in cut} == {
        g: pytest.approx(np.quantile([s for h, _, s, _ in rows if h == g], 0.8))
        for g in (None, "a", "b")}

    def auc(g, hit):
        pos, neg = ([s for h, label, s, _ in rows if h == g and (label == hit) == y]
                    for y in (True, False))
        return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))

    got = {r.g: r.auc for r in ranking.roc_auc(df, "l", "s", ["g"], ranges).collect()}
    assert got == {g: pytest.approx(auc(g, 1)) for g in (None, "a", "b")}
    got = ranking.roc_auc_ovr(df, "l", {0: "s", 1: "s"}, ["g"], ranges).collect()
    n = {g: [sum(h == g and label == k for h, label, *_ in rows) for k in (0, 1)]
         for g in (None, "a", "b")}
    assert {r.g: r.auc for r in got} == {g: pytest.approx(
        (n[g][0] * auc(g, 0) + n[g][1] * auc(g, 1)) / 60) for g in (None, "a", "b")}


@pytest.mark.parametrize("bound", [0, 100])
def test_null_safe_spread_join(spark, bound):
    big = spark.range(900).select(
        F.when(F.col("id") % 3 != 0, F.col("id") % 7).alias("k"), "id")
    small = spark.createDataFrame([(None, "n"), (1, "x")], "k long, v string")
    got = relational.spread_join(big, small, ["k"], "left", bound, null_safe=True)
    assert got.count() == 900 and got.columns == ["k", "id", "v"]
    assert got.where("v = 'n'").count() == 300 == got.where("k is null").count()
    assert got.where("v = 'x'").count() == big.where("k = 1").count()
