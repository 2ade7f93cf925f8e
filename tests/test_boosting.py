"""Boosting against a plain loop over rows, and the rule that stops it."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadline.plans import boosting, models

FEATURES = ["a", "b"]


def table(spark, classes, n=240, folds=2, seed=5):
    """fold, val, label, weight, features: every row once per fold, as a design has them."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        y = rng.randrange(classes)
        a, b = y + rng.gauss(0, 0.8), float(rng.randrange(4))
        for fold in range(folds):
            data.append((fold, i % folds == fold, y, 1.0 + (i % 3) / 2, a, b))
    return data, spark.createDataFrame(
        data, "fold int, val boolean, label int, weight double, a double, b double").repartition(3)


def chances(margin):
    if len(margin) == 1:
        p = 1 / (1 + math.exp(-margin[0]))
        return [1 - p, p]
    e = [math.exp(m) for m in margin]
    return [x / sum(e) for x in e]


def slow_tree(rows, depth, l2, least, bins):
    """Leaf steps by rows: recursive exact search over the same cuts."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = None
    if depth:
        for f in range(len(FEATURES)):
            for limit in range(bins):
                left = [r for r in rows if r[0][f] <= limit]
                gl, hl = sum(r[1] for r in left), sum(r[2] for r in left)
                if hl < least or h - hl < least:
                    continue
                gain = gl * gl / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g * g / (h + l2)
                if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = gain, f, limit
    if best is None:
        return -g / (h + l2)
    _, f, limit = best
    return (f, limit, slow_tree([r for r in rows if r[0][f] <= limit], depth - 1, l2, least, bins),
            slow_tree([r for r in rows if r[0][f] > limit], depth - 1, l2, least, bins))


def walk(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("classes, block", [(2, 10), (2, 2), (3, 10), (3, 3)])
def test_boost_by_plain_loops(spark, monkeypatch, classes, block):
    if block < 10:   # sums of many tasks
        monkeypatch.setattr(boosting, "ROWS_PER_TASK", 60)
    data, df = table(spark, classes)
    rounds, depth, step, l2, least = 4, 2, 0.3, 1.0, 1.0
    found = boosting.boost(df, FEATURES, classes, rounds, depth, step, l2, least, block=block)
    trees = 1 if classes == 2 else classes
    for fold in (0, 1):
        model = found[fold]
        assert model.getNumTrees == rounds
        own = [r for r in data if r[0] == fold]
        bins = model.bins([np.array([r[4] for r in own]), np.array([r[5] for r in own])])
        margin = [[0.0] * trees for _ in own]
        for _ in range(rounds):
            grown = []
            for c in range(trees):
                rows = []
                for k, r in enumerate(own):
                    if not r[1]:
                        p = chances(margin[k])[1 if trees == 1 else c]
                        hit = r[2] == (1 if trees == 1 else c)
                        rows.append((bins[k], r[3] * (p - hit), r[3] * p * (1 - p)))
                grown.append(slow_tree(rows, depth, l2, least, boosting.BINS))
            for k in range(len(own)):
                for c in range(trees):
                    margin[k][c] += step * walk(grown[c], bins[k])
        assert model.margins(bins) == pytest.approx(np.array(margin), abs=1e-9)
        p = boosting.probabilities(model.margins(bins))
        assert p.shape == (len(own), classes) and p.sum(1) == pytest.approx(np.ones(len(own)))


def pair_auc(scores, hits):
    won = sum((s > t) + (s == t) / 2 for s, y in zip(scores, hits) if y for t, z in zip(scores, hits) if not z)
    return won / (sum(hits) * (len(hits) - sum(hits)))


@pytest.mark.parametrize("classes", [2, 3])
def test_patience_keeps_the_best_prefix(spark, classes):
    """The score after every round is recomputed from the trees of a run without patience."""
    data, df = table(spark, classes, n=160)
    settings = dict(depth=3, step=0.8, least=0.1)
    whole = boosting.boost(df, FEATURES, classes, 24, **settings)
    found = boosting.boost(df, FEATURES, classes, 24, patience=5, block=4, **settings)
    for fold, model in found.items():
        own = [r for r in data if r[0] == fold and r[1]]
        free = whole[fold]
        bins = free.bins([np.array([r[4] for r in own]), np.array([r[5] for r in own])])
        scores = []
        for k in range(1, 25):
            cut = boosting.Boosted(free.cuts, classes, free.feature[:k], free.limit[:k],
                                   free.value[:k], free.gain)
            p = boosting.probabilities(cut.margins(bins))
            scores.append(pair_auc(p[:, 1].tolist(), [r[2] for r in own]) if classes == 2 else
                          float(np.mean([math.log(p[i, r[2]]) for i, r in enumerate(own)])))
        assert model.scores == pytest.approx(scores[:len(model.scores)], abs=1e-9)
        best, at = -1e9, 0
        for k, s in enumerate(scores):
            if s > best:
                best, at = s, k + 1
            if k + 1 - at >= 5:
                break
        assert model.getNumTrees == at
        assert model.value == pytest.approx(free.value[:at])


def test_prefix_rule():
    assert boosting.best_prefix([0.5, 0.7, 0.7, 0.6], 2) == (2, True)
    assert boosting.best_prefix([0.5, 0.7, 0.7, 0.8], 2) == (4, False)
    assert boosting.best_prefix([0.5, 0.7, 0.6], 2) == (2, False)
    assert boosting.best_prefix([None, None, None], 2) == (3, False)
    assert boosting.best_prefix([], 2) == (0, False)


def test_constant_features_and_one_fold(spark):
    rows = spark.createDataFrame([(0, False, i % 2, 1.0, 3.0) for i in range(20)],
                                 "fold int, val boolean, label int, weight double, a double")
    model = boosting.boost(rows, ["a"], 2, 3)[0]
    assert model.chances([np.array([3.0, -1.0])]) == pytest.approx(np.full((2, 2), 0.5))


def test_bins_on_both_sides_are_the_same(spark):
    _, df = table(spark, 3)
    cuts = boosting.cut_points(df, FEATURES)
    rows = df.select(*FEATURES, boosting.binned(FEATURES, cuts).alias("bins")).toPandas()
    model = boosting.Boosted(cuts, 3, *([None] * 3), None)
    want = model.bins([rows["a"].to_numpy(), rows["b"].to_numpy()])
    assert [list(b) for b in rows["bins"]] == want.tolist()


def test_design_of_a_cross_validation(spark):
    """Medians, weights and scales of each fold, by hand."""
    rng = random.Random(3)
    data = [(i, "xyz"[i % 3 if i % 5 else 0], None if i % 4 == 0 else rng.random(), float(i % 7))
            for i in range(90)] + [(99, None, 1.0, 1.0)]
    df = spark.createDataFrame(data, "i int, c string, a double, b double")
    of = models.design(df, FEATURES, "c", F.col("i"), ["i"], folds=3, keep=["i"])
    rows = of.rows.select("fold", "val", "id.i", "label", "balanced", *FEATURES).toPandas()
    assert of.classes == ["x", "y", "z"] and len(rows) == 270
    assert (rows[rows["val"]]["i"].sort_values().to_numpy() == np.arange(90)).all()
    for fold, own in rows.groupby("fold"):
        train = {r["i"] for _, r in own[~own["val"]].iterrows()}
        known = [a for i, _, a, _ in data if i in train and a is not None]
        holes = {i for i, _, a, _ in data if a is None}
        assert set(own[own["i"].isin(holes)]["a"].round(9)) == {round(float(np.median(known)), 9)}
        sizes = own[~own["val"]].groupby("label").size()
        for c, n in sizes.items():
            assert own[own["label"] == c]["balanced"].to_numpy() == pytest.approx(sizes.sum() / (3 * n))
        assert of.scale[fold]["b"] == pytest.approx(
            (own[~own["val"]]["b"].mean(), own[~own["val"]]["b"].std(ddof=0)))


def test_too_many_classes(spark):
    with pytest.raises(ValueError):
        models.fit_logit(spark.range(500).withColumn("a", F.lit(1.0)), ["a"], "id")


@pytest.mark.parametrize("classes", [2, 3])
def test_equal_rows_are_counted_and_folds_grown_apart(spark, monkeypatch, classes):
    """Every row five times: one job's worth of cells, and the trees of the passes over all rows."""
    _, df = table(spark, classes, n=120, folds=3)
    df = df.withColumn("a", F.round("a")).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(5)))).drop("_k")
    settings = dict(depth=3, step=0.5, patience=4, block=3)
    tracker, group = spark.sparkContext.statusTracker(), f"alone {classes}"
    spark.sparkContext.setJobGroup(group, group)
    alone = boosting.boost(df, FEATURES, classes, 9, **settings)
    spark.sparkContext.setJobGroup("other", "other")
    assert len(tracker.getJobIdsForGroup(group)) < 20   # a job for every level of every round before
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 40)
    passes = boosting.boost(df, FEATURES, classes, 9, **settings)
    assert set(alone) == set(passes) == {0, 1, 2}
    for f, model in alone.items():
        assert model.scores == pytest.approx(passes[f].scores, abs=1e-9)
        assert model.getNumTrees == passes[f].getNumTrees
        assert model.feature.tolist() == passes[f].feature.tolist()
        assert model.limit.tolist() == passes[f].limit.tolist()
        assert model.value == pytest.approx(passes[f].value, abs=1e-9)
        assert model.gain == pytest.approx(passes[f].gain)


def test_remembered_chances_are_those_of_every_row(spark, monkeypatch):
    data, df = table(spark, 3)
    model = boosting.boost(df, FEATURES, 3, 3)[0]
    monkeypatch.setattr(boosting, "KNOWN", 30)
    chances = model.remembering()
    for part in (data[:100], data[50:60], data[100:]):
        columns = [np.array([r[k] for r in part]) for k in (4, 5)]
        assert chances(columns) == pytest.approx(model.chances(columns))
