"""Forests of many rows: whole trees in tasks, held against plain loops and Spark's forests."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadline.plans import forests, models


class Fixed:
    """Draws every row once and tries the features in their order."""

    def poisson(self, n, shape):
        return np.broadcast_to(n, shape)

    def random(self, shape):
        return np.broadcast_to(np.arange(shape[1], dtype=float), shape)


def plain_tree(rows, weight, depth):
    """Chances by bins: a tree over (bins, class) by plain loops, with its pairs of leaves joined."""
    def counts(part):
        return [sum(y == c for _, y in part) * w for c, w in enumerate(weight)]

    def worth(part):
        own = counts(part)
        return sum(v * v for v in own) / sum(own)

    def node(part, level):
        best = None
        if level < depth and len({y for _, y in part}) > 1:
            for f in range(2):
                for cut in sorted({x[f] for x, _ in part})[:-1]:
                    a, b = ([r for r in part if (r[0][f] > cut) == side] for side in (False, True))
                    gain = worth(a) + worth(b) - worth(part)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, f, cut, a, b
        own = counts(part)
        if best is None:
            return [v / sum(own) for v in own]
        sides = node(best[3], level + 1), node(best[4], level + 1)
        if all(isinstance(s, list) for s in sides) and len({int(np.argmax(s)) for s in sides}) == 1:
            return [v / sum(own) for v in own]
        return best[1], best[2], *sides

    def chances(x, at):
        return at if isinstance(at, list) else chances(x, at[3] if x[at[0]] > at[1] else at[2])

    whole = node(rows, 0)
    return {x: chances(x, whole) for x, _ in rows}


@pytest.mark.parametrize("depth", [0, 1, 3, 30])
def test_trees_against_plain_loops(monkeypatch, depth):
    rng = np.random.default_rng(3)
    data = [((int(a), int(b)), int((a + b + rng.integers(0, 4)) % 3)) for a, b in rng.integers(0, 7, (120, 2))]
    weight = np.array([1.0, 0.5, 2.0])
    cells = sorted(set(data))
    x, y = np.array([c for c, _ in cells], np.uint8), np.array([c for _, c in cells], np.uint8)
    n = np.array([data.count(c) for c in cells])
    want = plain_tree(data, weight, depth)
    for step in (forests.COUNTED, 10):   # also a few nodes and rows at a time
        monkeypatch.setattr(forests, "COUNTED", step)
        trees, share = forests.grow(x, y, n, weight, 7, depth, 3, Fixed())
        again = forests.Trees.unpacked(trees.packed())
        sums = np.zeros((len(x), 3))
        again.add(x, sums)
        assert sums / 3 == pytest.approx(np.array([want[tuple(map(int, c))] for c in x]), abs=1e-6)
        assert share.shape == (3, 2) and share.sum(1) == pytest.approx(np.full(3, float(depth > 0)))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = []
    for i in range(1500):
        c = int(rng.integers(0, 3))
        data.append((i, "xyz"[c], float(c + rng.normal()), None if i % 11 == 0 else float(rng.random()),
                     float(rng.integers(0, 3)) * c))
    return models.materialise(spark.createDataFrame(data, "i int, c string, a double, b double, d double"))


def test_as_good_as_sparks_forests(rows, monkeypatch):
    """Scores of validation rows and of a fitted forest; importances."""
    found, names = {}, ["a", "b", "d"]
    fits = {"forest": models.algorithms(trees=60)["forest"]}
    for most in (10_000, 0):
        monkeypatch.setattr(models, "FOREST_MOST", most)
        monkeypatch.setattr(models, "FOREST_CELLS", 10_000)
        aucs = models.compare_models(rows, names, "c", F.col("i"), ["i"], folds=2, fits=fits).collect()
        assert sorted((r.fold, r.trees) for r in aucs) == [(0, 60), (1, 60)]
        model = models.fit_forest(rows, names, "c", 60)
        assert model.trees == 60
        scored = models.score(rows, model).orderBy("i").toPandas()
        shares = {r.feature: r.importance for r in models.importance(rows.sparkSession, model).collect()}
        assert len(scored) == 1500 and list(scored.i) == list(range(1500))
        found[most] = sorted(r.auc for r in aucs), scored[["p_x", "p_y", "p_z"]].to_numpy(), shares
    spark_, own = found.values()
    assert own[0] == pytest.approx(spark_[0], abs=0.02) and min(own[0]) > 0.8
    assert own[1].sum(1) == pytest.approx(1.0, abs=1e-6) and np.abs(own[1] - spark_[1]).mean() < 0.05
    assert own[2] == pytest.approx(spark_[2], abs=5)


def test_many_rows_do_not_meet_every_tree(spark, monkeypatch):
    """Beyond the bound no row is taken through Spark's passes; too many cells stay with Spark."""
    df = spark.range(0, 3000, 1, 4).selectExpr("id AS i", "CAST(id % 2 AS int) AS hit", "id % 7 AS a", "id % 3 AS b")
    fits = {"forest": models.algorithms(trees=5)["forest"]}

    class Called(Exception):
        pass

    def never(**_):
        raise Called

    monkeypatch.setattr(models, "RandomForestClassifier", never)
    monkeypatch.setattr(models, "FOREST_MOST", 1000)
    monkeypatch.setattr(models, "FOREST_CELLS", 500)
    found = models.compare_models(df, ["a", "b"], "hit", F.col("i"), ["i"], folds=2, fits=fits)
    assert found.count() == 2
    assert models.score(df, models.fit_forest(df, ["a", "b"], "hit", 5)).count() == 3000
    monkeypatch.setattr(models, "FOREST_CELLS", 10)
    with pytest.raises(Called):
        models.fit_forest(df, ["a", "b"], "hit", 5)


def test_a_frequent_value_is_apart_from_those_above(spark):
    df = spark.range(1000).selectExpr("IF(id < 400, 0D, id / 1000D) AS v", "CAST(id % 3 AS double) AS few")
    many, few = forests.edges(df, ["v", "few"])
    assert len(many) < forests.BINS and many[0] == pytest.approx(0.4) and few == [1.0, 2.0]
