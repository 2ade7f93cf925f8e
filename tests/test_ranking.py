import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leadline.operators import ranking, summary

SHARES = [0.0, 0.11, 0.25, 0.5, 0.8, 1.0]


@pytest.fixture(scope="module")
def values():
    """Group a holds most rows, and a third of all rows are one value."""
    rng = random.Random(5)
    rows = [("a", 3.0)] * 300 + [("a", rng.gauss(0, 10)) for _ in range(400)]
    rows += [("b", rng.expovariate(1)) for _ in range(101)] + [("c", 7.5), ("d", None)]
    return rows


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_percentiles_by_group(spark, values, ranges):
    df = spark.createDataFrame(values, "g string, v double").repartition(3)
    got = ranking.quantile_table(df, ["v"], SHARES, ["g"], ranges).collect()
    assert {r.g for r in got} == {"a", "b", "c"}
    for r in got:
        own = [v for g, v in values if g == r.g and v is not None]
        assert r.n == len(own)
        assert r.value == pytest.approx(np.quantile(own, r.share))


def test_quantiles_of_several_columns(spark, values):
    df = spark.createDataFrame([(v, (v or 1.0) ** 2) for _, v in values], "v double, w double")
    got = ranking.quantile_table(df, ["v", "w"], [0.5, 0.9]).collect()
    frame = df.toPandas()
    for r in got:
        assert r.value == pytest.approx(frame[r.feature].quantile(r.share))
    assert ranking.medians(df, ["v"])["v"] == pytest.approx(frame.v.median())


def test_median_of_even_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (10.0, None)],
                               "v double, w double")
    assert ranking.medians(df, ["v", "w"]) == {"v": 2.5, "w": None}


@pytest.mark.parametrize("ranges", [1, 16])
def test_rank_pct_equals_pandas(spark, values, ranges):
    rows = [(i, v) for i, (_, v) in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v double").repartition(4)
    got = ranking.rank_pct(df, "v", "pct", ranges).orderBy("i").toPandas()
    want = pd.Series([v for _, v in rows], dtype=float).rank(pct=True) * 100
    assert len(got) == len(rows)
    np.testing.assert_allclose(got.pct.to_numpy(dtype=float), want.to_numpy(), equal_nan=True)


def brute_auc(rows):
    pos, neg = [s for l, s in rows if l], [s for l, s in rows if not l]
    if not pos or not neg:
        return None
    won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return won / (len(pos) * len(neg))


def test_roc_auc(spark):
    rng = random.Random(3)
    rows = [(g, rng.randint(0, 1), round(rng.random() + 0.3 * (g == "x"), 1))
            for g in "xxxxy" for _ in range(40)] + [("one", 1, 0.5), ("one", 1, 0.7)]
    df = spark.createDataFrame(rows, "g string, l int, s double")
    got = {r.g: r.auc for r in ranking.roc_auc(df, "l", "s", ["g"], 8).collect()}
    for g in ("x", "y"):
        assert got[g] == pytest.approx(brute_auc([(l, s) for gg, l, s in rows if gg == g]))
    assert got["one"] is None
    flipped = ranking.roc_auc(df.withColumn("s", -F.col("s")), "l", "s", ["g"], 8).collect()
    for r in flipped:
        if r.auc is not None:
            assert r.auc == pytest.approx(1 - got[r.g])


def test_roc_auc_ovr_leaves_out_missing_classes(spark):
    rng = random.Random(4)
    rows = [(c, rng.random(), rng.random(), 0.1) for c in "aab" for _ in range(20)]
    df = spark.createDataFrame(rows, "c string, sa double, sb double, sz double")
    got = ranking.roc_auc_ovr(df, "c", {"a": "sa", "b": "sb", "z": "sz"}).first().auc
    a = brute_auc([(r[0] == "a", r[1]) for r in rows])
    b = brute_auc([(r[0] == "b", r[2]) for r in rows])
    assert got == pytest.approx((40 * a + 20 * b) / 60)


def test_folds_are_balanced_and_stable(spark):
    rows = [(i, "big" if i % 10 else "small") for i in range(997)]
    df = spark.createDataFrame(rows, "k long, c string")
    folds = None
    for n in (1, 5):
        got = ranking.stratified_folds(df.repartition(n), "c", 5, F.col("k"), ["k"], 2, 16)
        found = {r.k: r.fold for r in got.collect()}
        assert folds is None or folds == found
        folds = found
    assert len(folds) == 997
    for c in ("big", "small"):
        sizes = pd.Series([folds[k] for k, kc in rows if kc == c]).value_counts()
        assert set(sizes.index) == set(range(5)) and sizes.max() - sizes.min() <= 1


def test_histogram(spark):
    data = [0.0, 0.1, 1.0, 5.0, 9.99, 10.0, None]
    df = spark.createDataFrame([(v,) for v in data], "v double")
    got = summary.histogram(df, "v", 10).orderBy("bin").collect()
    want, edges = np.histogram([v for v in data if v is not None], 10)
    assert [r.n for r in got] == list(want)
    assert [r.lo for r in got] == pytest.approx(list(edges[:-1]))
    flat = summary.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 4)
    assert flat.agg(F.sum("n")).first()[0] == 2
    assert summary.histogram(df.where("v > 99"), "v", 4).count() == 0


def test_folds_keep_null_labels_and_great_keys(spark):
    rows = [(k * 10**15 * 2 + k, [None, "a", "b"][k % 3]) for k in range(60)]
    df = spark.createDataFrame(rows, "k bigint, label string")
    found = ranking.stratified_folds(df, "label", 5, F.col("k"), ["k"]).collect()
    assert len(found) == 60
    for label in (None, "a", "b"):
        folds = [r["fold"] for r in found if r["label"] == label]
        assert sorted(folds) == sorted(list(range(5)) * 4)
