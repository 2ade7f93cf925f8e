import random

import duckdb
import pytest
from pyspark.sql import functions as F

from leadline.checks import fixture
from leadline.plans import boosting, models, outcomes, payoffs

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    data = []
    for i in range(600):
        c = rng.choice("xyyz")
        data.append((i, c, int(c == "x"), {"x": 0.0, "y": 2.0, "z": 4.0}[c] + rng.gauss(0, 1),
                     None if i % 9 == 0 else rng.random()))
    return spark.createDataFrame(data, "i int, c string, hit int, a double, b double").cache()


def test_impute_uses_the_medians_of_the_first(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "v double")
    other = spark.createDataFrame([(None,), (7.0,)], "v double")
    a, b = models.impute_median(train, ["v"], other)
    assert sorted(r.v for r in a.collect()) == [1.0, 2.0, 2.5, 3.0, 10.0]
    assert sorted(r.v for r in b.collect()) == [2.5, 7.0]


def test_weights(rows):
    balanced = models.class_weights(rows, "c").agg(F.sum("weight")).first()[0]
    assert balanced == pytest.approx(600)
    weighted = models.class_weights(rows, "hit", "positive")
    sums = {r.hit: r.s for r in weighted.groupBy("hit").agg(F.sum("weight").alias("s")).collect()}
    assert sums[0] == pytest.approx(sums[1])


def test_labels_and_scaling(rows):
    codes = models.encode_labels(rows, "c").select("c", "c_encoded").distinct().collect()
    assert {r.c: r.c_encoded for r in codes} == {"x": 0, "y": 1, "z": 2}
    scaled = models.standardise(rows, models.scaling(rows, ["a"]))
    mean, dev = scaled.agg(F.avg("a"), F.stddev_pop("a")).first()
    assert abs(mean) < 1e-9 and dev == pytest.approx(1)


@pytest.mark.parametrize("fit", [
    lambda df: models.fit_logit(df, FEATURES, "c"),
    lambda df: models.fit_logit(df, FEATURES, "c", l1=True, each_class=True),
    lambda df: models.fit_forest(df, FEATURES, "c", 5),
    lambda df: models.fit_boost(df, FEATURES, "c", 3),
])
def test_probabilities(rows, fit):
    model = fit(rows)
    assert model.classes == ["x", "y", "z"]
    scored = models.score(rows, model)
    assert scored.columns == [*rows.columns, "p_x", "p_y", "p_z"] and scored.count() == 600
    off = scored.where(F.abs(F.col("p_x") + F.col("p_y") + F.col("p_z") - 1) > 1e-9).count()
    assert off == 0
    means = {r.c: r for r in scored.groupBy("c").agg(
        *[F.avg(f"p_{c}").alias(c + "_") for c in "xyz"]).collect()}
    assert means["x"]["x_"] > means["z"]["x_"] and means["z"]["z_"] > means["x"]["z_"]
    shares = models.importance(rows.sparkSession, model).collect()
    assert sum(r.importance for r in shares) == pytest.approx(100)
    assert shares[0].feature == "A"


def test_one_class_gets_all_the_probability(rows):
    only = rows.where("c = 'y'")
    for fit in (models.fit_logit, models.fit_forest, models.fit_boost):
        model = fit(only, FEATURES, "c")
        assert models.score(rows, model).where("p_y <> 1").count() == 0
        chances = model.probabilities(rows, "m").select(models.chance("m", "never")).first()
        assert chances[0] == 0.0
    with pytest.raises(ValueError):
        models.fit_logit(rows.where("c = 'q'"), FEATURES, "c")


def test_boost_stops_on_validation_rows(rows):
    marked = rows.withColumn("val", F.col("i") % 5 == 0)
    model = models.fit_boost(marked, FEATURES, "hit", 60, validation="val", patience=3)
    scores = model.models[0].scores
    assert 1 <= model.trees < 60 and model.trees == boosting.best_prefix(scores, 3)[0]


def test_comparison_and_report(rows):
    fits = models.algorithms(trees=3, iterations=10)
    scores = models.compare_models(rows, FEATURES, "c", F.col("i"), ["i"], folds=2,
                                   fits={k: fits[k] for k in ("forest", "ridge")})
    got = scores.collect()
    assert len(got) == 4 and all(0.6 < r.auc <= 1 for r in got)
    report = {r.algorithm: r for r in models.cv_report(scores, trees="trees").collect()}
    ridge = [r.auc for r in got if r.algorithm == "ridge"]
    assert report["ridge"].median_auc == pytest.approx(sum(ridge) / 2)
    assert report["ridge"].std_auc == pytest.approx(abs(ridge[0] - ridge[1]) / 2)
    assert report["forest"].median_trees == 3 and report["ridge"].median_trees is None


@pytest.mark.parametrize("label, classes", [("hit", 2), ("c", 3)])
def test_aucs_of_all_fits_by_sql(rows, tmp_path, label, classes):
    """Folds and AUCs out of the stored scores, by DuckDB."""
    of = models.design(rows, FEATURES, label, F.col("i"), ["i"], folds=3, keep=["i"])
    fits = models.algorithms(trees=12, iterations=20, patience=4, depth=4, plain=True)
    scores, sizes = models.cross_scores(of, fits)
    aucs = {(r.algorithm, r.fold): r.auc for r in models.fold_aucs(scores, of.classes, sizes).collect()}
    assert len(aucs) == 15 and {s[0] for s in sizes} == set(fits)
    whole = sum((F.col(f"s{i}") for i in range(1, classes)), F.col("s0"))
    assert scores.where(F.abs(whole - 1) > 1e-9).count() == 0
    scores.select("algorithm", "fold", "id.i", F.col("label").cast("string").alias("label"), *[
        f"s{i}" for i in range(classes)]).write.parquet(str(tmp_path / "scores"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW scores AS SELECT * FROM '{tmp_path}/scores/*.parquet'")
    source = rows.select("i", F.col(label).cast("string").alias("label")).toPandas()  # noqa: F841
    wrong = duck.sql("""
        WITH folds AS (SELECT i, label, (row_number() OVER (PARTITION BY label
            ORDER BY (i % 1000003 * 7919) % 1000003, i) - 1) % 3 AS fold FROM source),
        fits AS (SELECT DISTINCT algorithm FROM scores)
        SELECT count(*) FROM (SELECT algorithm, fold, i, label FROM folds, fits) f
        FULL JOIN scores s USING (algorithm, fold, i, label) WHERE f.i IS NULL OR s.i IS NULL""")
    assert wrong.fetchall() == [(0,)]
    ends = [(str(of.classes[1]), "s1")] if classes == 2 else [
        (c, f"s{k}") for k, c in enumerate(of.classes)]
    ranks = " UNION ALL ".join(f"""
        SELECT algorithm, fold, label = '{c}' AS hit, '{c}' AS class,
            rank() OVER (PARTITION BY algorithm, fold ORDER BY {s})
            + (count(*) OVER (PARTITION BY algorithm, fold, {s}) - 1) / 2.0::DOUBLE AS place
        FROM scores""" for c, s in ends)
    want = duck.sql(f"""SELECT algorithm, fold, sum(auc * n) / sum(n) FROM (
        SELECT algorithm, fold, class, sum(hit::INTEGER) AS n,
            (sum(place) FILTER (hit) - n * (n + 1) / 2) / (n * (count(*) - n)) AS auc
        FROM ({ranks}) GROUP BY ALL) GROUP BY ALL""").fetchall()
    assert aucs == {(a, f): pytest.approx(v) for a, f, v in want}
    assert min(aucs.values()) > 0.6


def test_payoffs_out_of_the_scored_probabilities(spark, tmp_path):
    """The worked examples with small fits; DuckDB recomputes the payoffs from the chances."""
    sf, maps = "/root/testdata/sf0.001", [f"chances_{n}" for n in payoffs.NAMES]
    got = payoffs.payoff_scenarios(fixture.tracking(spark, sf), fixture.double_labels(spark, sf),
                                   trees=8, patience=3, forest=5, keep=maps)
    got.write.parquet(str(tmp_path / "payoffs"))
    assert got.count() == len(payoffs.EXAMPLES)

    def change(name, values):
        return " + ".join(f"coalesce({name}['{c}'], 0) * ({v} - 0.836)" for c, v in values.items())

    wrong = duckdb.sql(f"""
        SELECT count(*) FILTER (abs(p - pickoff_prob) > 2e-5 OR abs(s - steal_prob) > 2e-5
            OR abs(0.0016296 - p * 0.596 - pickoff_payoff) > 2e-5 OR abs(stay - pitch_stay_payoff) > 2e-5
            OR abs(0.6486 * (s * (1.03 - 0.836) + (1 - s) * (0.24 - 0.836)) + stay - pitch_steal_payoff) > 2e-5
            OR abs(o - bip_out_payoff) > 2e-5 OR abs(h - bip_single_payoff) > 2e-5
            OR abs(d - bip_double_payoff) > 2e-5), count(*)
        FROM (SELECT *, 0.1125 * o + 0.0354 * h + 0.0166 * d + 0.021329803603828152 AS stay
            FROM (SELECT *, chances_pickoff['1'] AS p, chances_steal['0'] AS s, {change('chances_outs', payoffs.OUT_VALUES)} AS o,
                {change('chances_singles', payoffs.SINGLE_VALUES)} AS h,
                {change('chances_doubles', payoffs.DOUBLE_VALUES)} AS d
                FROM '{tmp_path}/payoffs/*.parquet'))""").fetchall()
    assert wrong == [(0, len(payoffs.EXAMPLES))]


def test_final_boosting_takes_the_median_of_the_best_rounds(rows, monkeypatch):
    """Two classes; the folds' best rounds are those of the stored validation scores."""
    of = outcomes.OutcomeSet(rows.withColumnsRenamed({"i": "play_id"}).withColumn(
        "game_str", F.lit("G")), FEATURES, "hit")
    found = models.boost_folds(of.design(), 30, 4)
    best = sorted(boosting.best_prefix(m.scores, 4)[0] for m in found.values())
    assert payoffs.fit_tuned(of, 30, 4).trees == best[2]


def test_payoffs_by_hand(spark):
    df = spark.createDataFrame([(0.1, 0.7)], "p double, s double")
    outs = {c: F.lit(0.25) for c in payoffs.OUT_VALUES}
    singles = {c: F.lit(1.0 if c == "100" else 0.0) for c in payoffs.SINGLE_VALUES}
    doubles = {c: F.lit(1.0 if c == "011" else 0.0) for c in payoffs.DOUBLE_VALUES}
    r = payoffs.payoffs(df, F.col("p"), F.col("s"), outs, singles, doubles).first()
    out = 0.25 * (0.0961 + 0.829 + 0.536 + 0.307) - 0.836
    single, double = 0.407 - 0.836, 1.83 - 0.836
    stay = 0.1125 * out + 0.0354 * single + 0.0166 * double + 0.021329803603828152
    run = 0.6486 * (0.7 * (1.03 - 0.836) + 0.3 * (0.24 - 0.836)) + stay
    assert tuple(r) == pytest.approx(
        (0.1, 0.7, 0.0016296 - 0.0596, stay, run, out, single, double), abs=6e-6)


@pytest.mark.parametrize("names", [("outs", "singles"), ("pickoffs",)])
def test_sets_of_one_kind_of_play_make_only_what_they_need(spark, monkeypatch, names):
    """No pop times, no releases of other plays; the rows are those of the shared tables."""
    t = fixture.tracking(spark, "/root/testdata/sf0.001")
    shared = outcomes.outcome_sets(t, names=names, measures=outcomes.Measures.of(t))

    def never(*_):
        raise AssertionError("not needed")

    monkeypatch.setattr(outcomes, "release_time", never)
    monkeypatch.setattr(outcomes, "pop_time", never)
    own = outcomes.outcome_sets(t, names=names)
    assert set(own) == set(names)
    for name in names:
        a, b = own[name].rows, shared[name].rows
        assert a.count() > 0 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_rows_of_a_forest_are_dealt_over_the_cores(spark, monkeypatch):
    """Thousands of rows that lie in one partition or file."""
    df = spark.range(0, 5000, 1, 1).selectExpr("id AS i", "CAST(id % 2 AS int) AS hit", "id % 7 AS a", "id % 3 AS b")
    seen, real = [], models.forest_models

    def forest(rows, trees, depth, seed):
        sizes = [len(p) for p in rows.select("_label").rdd.glom().collect()]
        seen.append((sum(sizes), max(sizes)))
        return real(rows, trees, depth, seed)

    monkeypatch.setattr(models, "forest_models", forest)
    models.fit_forest(df, FEATURES, "hit", 3, 3)
    fits = {"forest": models.algorithms(trees=3, depth=3)["forest"]}
    models.compare_models(df, FEATURES, "hit", F.col("i"), ["i"], folds=2, fits=fits)
    assert [n for n, _ in seen] == [5000, 2500, 2500]
    assert all(most <= 0.6 * n for n, most in seen)
