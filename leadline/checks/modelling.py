"""Data work around models, fits, comparison and payoffs.

Fits run with the trees, folds, patience and iterations of the full runs: logistic ones and
boosting on all of ``lineitem``, comparisons and forests on the outcome sets.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from leadline.checks import fixture
from leadline.checks.generic import table
from leadline.checks.registry import check
from leadline.checks.tracking import sql as tracking_sql
from leadline.functions.codes import PLAY
from leadline.operators import ranking
from leadline.plans import models, outcomes, payoffs as pay
from leadline.session import materialise

FEATURES = ["l_quantity", "l_discount", "l_tax"]
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
# Lines are not unique by number, so ties are settled by all of these.
TIES = [*LINE, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def lines(spark, sf):
    return table(spark, sf, "lineitem")


def with_holes(spark, sf):
    """Line items in which some taxes are missing."""
    return lines(spark, sf).withColumn("l_tax", F.when(
        (F.col("l_orderkey") + F.col("l_linenumber")) % 7 != 0, F.col("l_tax")))


def returned(df):
    return df.withColumn("returned", (F.col("l_returnflag") == "R").cast("int"))


HOLES = """WITH holes AS (SELECT * REPLACE (CASE WHEN (l_orderkey + l_linenumber) % 7 <> 0
    THEN l_tax END AS l_tax) FROM lineitem)"""


@check(HOLES + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    round(coalesce(l_tax, (SELECT median(l_tax) FROM holes WHERE l_linestatus = 'O')), 6) AS l_tax
FROM holes""")
def impute_median(spark, sf):
    """Medians of one part, put into that part and into the other."""
    rows = with_holes(spark, sf)
    train, other = (rows.where(F.col("l_linestatus") == s) for s in ("O", "F"))
    filled = models.impute_median(train, FEATURES, other)
    return filled[0].unionByName(filled[1]).select(*LINE, F.round("l_tax", 6).alias("l_tax"))


FOLDED = f"""SELECT *, CAST((row_number() OVER (PARTITION BY l_returnflag
    ORDER BY (l_orderkey * 7919 + 3 * 104729) % 1000003, {', '.join(TIES)}) - 1) % 5 AS INTEGER)
    AS fold FROM lineitem"""


@check(f"SELECT {', '.join(LINE)}, l_returnflag, l_extendedprice, fold FROM ({FOLDED})")
def stratified_folds(spark, sf):
    rows = ranking.stratified_folds(
        lines(spark, sf), "l_returnflag", 5, F.col("l_orderkey"), TIES, seed=3)
    return rows.select(*LINE, "l_returnflag", "l_extendedprice", "fold")


@check("""
WITH s AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, n, round((SELECT sum(n) FROM s) / ((SELECT count(*) FROM s) * n::DOUBLE), 6)
    AS balanced,
    round(CASE l_returnflag WHEN 'R' THEN (SELECT sum(n) FROM s WHERE l_returnflag <> 'R') / n::DOUBLE
        ELSE 1 END, 6) AS positive
FROM s""")
def class_weights(spark, sf):
    rows = models.class_weights(lines(spark, sf), "l_returnflag", output="balanced")
    rows = models.class_weights(rows, "l_returnflag", "positive", "R", "positive")
    return rows.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.max("balanced"), 6).alias("balanced"),
        F.round(F.max("positive"), 6).alias("positive"))


@check("""
SELECT o_orderkey, o_orderpriority,
    CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code
FROM orders""")
def encode_labels(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return models.encode_labels(rows, "o_orderpriority", "code")


@check("SELECT " + ", ".join(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"] + [
    f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem), 6) "
    f"AS {c}" for c in FEATURES]) + " FROM lineitem")
def standardise(spark, sf):
    rows = lines(spark, sf).select(*LINE, *FEATURES)
    scaled = models.standardise(rows, models.scaling(rows, FEATURES))
    return scaled.withColumns({c: F.round(c, 6) for c in FEATURES})


def _auc_sql(rows, by):
    """AUC by ranks over (by, hit, score)."""
    return f"""
    SELECT {by}, (sum(hit * avg_rank) - sum(hit) * (sum(hit) + 1) / 2.0)
        / nullif(sum(hit)::DOUBLE * sum(1 - hit), 0) AS auc, sum(hit) AS n
    FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score)
            + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0::DOUBLE AS avg_rank
        FROM ({rows}))
    GROUP BY {by}"""


_HIT_SQL = """SELECT l_linestatus, l_linenumber, (l_returnflag = 'R')::INTEGER AS hit,
    l_extendedprice AS score FROM lineitem"""


@check(f"SELECT l_linestatus, round(auc, 6) AS auc FROM ({_auc_sql(_HIT_SQL, 'l_linestatus')})")
def roc_auc(spark, sf):
    rows = ranking.roc_auc(
        returned(lines(spark, sf)), "returned", "l_extendedprice", ["l_linestatus"])
    return rows.select("l_linestatus", F.round("auc", 6).alias("auc"))


SCORES = {"A": "l_quantity", "N": "l_discount", "R": "l_tax"}
_OVR_SQL = " UNION ALL ".join(
    f"SELECT l_linestatus, '{c}' AS class, (l_returnflag = '{c}')::INTEGER AS hit, {s} AS score "
    f"FROM lineitem" for c, s in SCORES.items())


@check(f"""SELECT l_linestatus, round(sum(auc * n) / sum(n), 6)::DOUBLE AS auc
FROM ({_auc_sql(_OVR_SQL, 'l_linestatus, class')}) WHERE auc IS NOT NULL GROUP BY l_linestatus""")
def roc_auc_ovr(spark, sf):
    rows = ranking.roc_auc_ovr(lines(spark, sf), "l_returnflag", SCORES, ["l_linestatus"])
    return rows.select("l_linestatus", F.round("auc", 6).alias("auc"))


@check(f"""SELECT l_linestatus AS algorithm, round(median(auc), 6) AS median_auc,
    round(stddev_pop(auc), 6) AS std_auc, median(n)::DOUBLE AS median_trees
FROM ({_auc_sql(_HIT_SQL, 'l_linestatus, l_linenumber')}) GROUP BY l_linestatus""")
def cv_report(spark, sf):
    """Line status stands in for the algorithm, line number for the fold."""
    rows = returned(lines(spark, sf)).withColumnRenamed("l_linestatus", "algorithm")
    by = ["algorithm", "l_linenumber"]
    sizes = rows.groupBy(*by).agg(F.sum("returned").cast("int").alias("trees"))
    scores = ranking.roc_auc(rows, "returned", "l_extendedprice", by).join(sizes, by)
    report = models.cv_report(scores, trees="trees")
    return report.select("algorithm", *[
        F.round(c, 6).alias(c) for c in ("median_auc", "std_auc")], "median_trees")


# -- fits ----------------------------------------------------------------------------
#
# The numbers of a fit are Spark's own, so the oracles state what holds for every right fit:
# each row is scored once, its probabilities add up to one, an unpenalised intercept makes the
# weighted probabilities of a class add up to the weighted rows of that class, and at the
# optimum the gradient is the penalty's.

def _flags(spark, sf):
    return with_holes(spark, sf).select(*LINE, "l_returnflag", *FEATURES)


def _binary(spark, sf):
    return returned(with_holes(spark, sf)).select(*LINE, "returned", *FEATURES)


def _totals(rows, model, keys=LINE):
    """The keys and the sum of the probabilities of each row."""
    whole = sum((F.col(f"p_{c}") for c in model.classes[1:]), F.col(f"p_{model.classes[0]}"))
    return models.score(rows, model).select(*keys, F.round(whole, 9).alias("total"))


def _gradient(rows, model, label):
    """(class, term, slope): derivative of the weighted log loss of an L2 fit, with its penalty.

    Terms are the intercept and the features, as the fit sees them: filled and standardised.
    """
    fit, n = model.models[0], rows.count()
    two = len(model.classes) == 2
    weights = models.class_weights(rows, label)
    scored = models.standardise(models.fill_medians(
        models.score(weights, model), model.medians), model.scale)
    table = []
    for row, c in enumerate(model.classes[1:] if two else model.classes):
        miss = F.col("weight") * (F.col(f"p_{c}") - (F.col(label) == F.lit(c)).cast("double")) / n
        beta = fit.coefficientMatrix.toArray()[row]
        terms = [("intercept", F.lit(1.0), 0.0)] + [
            (f, F.col(f), float(v)) for f, v in zip(model.features, beta)]
        table += [(str(c), name, F.sum(miss * x) + F.lit(v / n)) for name, x, v in terms]
    sums = scored.agg(*[v.alias(f"t{i}") for i, (_, _, v) in enumerate(table)])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("class"), F.lit(name).alias("term"),
                 F.abs(F.col(f"t{i}")).alias("slope")) for i, (c, name, _) in enumerate(table)])))


_TERMS = "unnest(['intercept', 'l_quantity', 'l_discount', 'l_tax']) AS term"


@check(f"SELECT '1' AS class, {_TERMS}, false AS steep")
def fit_logit_l2(spark, sf):
    """At the optimum of the L2 fit the gradient vanishes (to 1e-4 of the mean loss)."""
    rows = materialise(_binary(spark, sf))
    model = models.fit_logit(rows, FEATURES, "returned")
    return _gradient(rows, model, "returned").select(
        "class", "term", (F.col("slope") > 1e-4).alias("steep"))


@check(f"SELECT class, {_TERMS}, false AS steep FROM (SELECT DISTINCT l_returnflag AS class FROM lineitem)")
def fit_logit_multi(spark, sf):
    """As ``fit_logit_l2``, for one fit over three classes."""
    rows = materialise(_flags(spark, sf))
    model = models.fit_logit(rows, FEATURES, "l_returnflag")
    return _gradient(rows, model, "l_returnflag").select(
        "class", "term", (F.col("slope") > 1e-4).alias("steep"))


@check(f"SELECT '1' AS class, {_TERMS}, false AS beyond")
def fit_logit_l1(spark, sf):
    """No slope exceeds the L1 penalty, and the intercept has none."""
    rows = materialise(_binary(spark, sf))
    model = models.fit_logit(rows, FEATURES, "returned", l1=True)
    n = rows.count()
    slopes = _gradient(rows, model, "returned")
    # _gradient adds the L2 penalty v / n, which is small beside 1 / n times the sign
    allowed = F.when(F.col("term") == "intercept", 1e-4).otherwise(
        (1 + float(abs(model.models[0].coefficientMatrix.toArray()).max())) / n + 1e-4)
    return slopes.select("class", "term", (F.col("slope") > allowed).alias("beyond"))


_TOTALS = f"SELECT {', '.join(LINE)}, 1::DOUBLE AS total FROM lineitem"


@check(_TOTALS)
def fit_boost(spark, sf):
    """Two classes; a fold stops the boosting."""
    rows = materialise(ranking.stratified_folds(
        returned(with_holes(spark, sf)), "returned", 5, F.col("l_orderkey"), TIES).withColumn(
        "held", F.col("fold") == 0).select(*LINE, "returned", "held", *FEATURES))
    return materialise(_totals(rows, models.fit_boost(rows, FEATURES, "returned", validation="held")))


@check(_TOTALS)
def fit_boost_multi(spark, sf):
    """Three classes in one run; a fold stops the boosting."""
    rows = materialise(ranking.stratified_folds(
        with_holes(spark, sf), "l_returnflag", 5, F.col("l_orderkey"), TIES).withColumn(
        "held", F.col("fold") == 0).select(*LINE, "l_returnflag", "held", *FEATURES))
    return materialise(_totals(
        rows, models.fit_boost(rows, FEATURES, "l_returnflag", validation="held")))


@check(_TOTALS)
def score(spark, sf):
    rows = _flags(spark, sf)
    return _totals(rows, models.fit_logit(rows, FEATURES, "l_returnflag"))


# -- outcome sets ----------------------------------------------------------------------

def game_key():
    return F.expr("cast(substring(game_str, 2) AS bigint) * 1000 + play_id")


# The rows and labels of each set as DuckDB text, with the tables they need.
_HITS = "SELECT game_str, play_id, base_state AS label, {f} FROM hits WHERE batter_result = '{r}'"
_BIP = ", ".join(outcomes.BIP_FEATURES)
SETS = {
    "pickoffs": (f"""SELECT j.game_str, j.play_id, j.pickoff_result AS label, k.l0 AS lead_distance,
        k.v0 AS velocity, k.a0 AS acceleration, k.j0 AS jerk, s.sprint_speed FROM judged j
        JOIN at_pickoff k ON k.game_str = j.game_str AND k.play_id = j.play_id
        LEFT JOIN speeds s ON s.runner_id = j.runner_id WHERE j.pickoff_result <> -1""",
        ("judged", "at_pickoff", "speeds")),
    "steals": ("""SELECT e.game_str, e.play_id, e.outcome AS label, s.sprint_speed,
        p.average_pop_time, k.l0 AS lead_distance, k.v0 AS velocity, k.a0 AS acceleration
        FROM ended e JOIN at_pitch k ON k.game_str = e.game_str AND k.play_id = e.play_id
        LEFT JOIN speeds s ON s.runner_id = e.runner_id
        LEFT JOIN pops p ON p.catcher_id = e.catcher_id WHERE k.l0 IS NOT NULL
            AND (s.sprint_speed IS NOT NULL OR p.average_pop_time IS NOT NULL)""",
        ("ended", "at_pitch", "speeds", "pops")),
    "outs": (_HITS.format(f=_BIP, r="Out") + " AND base_state NOT IN ('110', '101', '011')", ("hits",)),
    "singles": (_HITS.format(f=_BIP, r="1B"), ("hits",)),
    "doubles": (f"""SELECT h.game_str, h.play_id, d.base_state AS label, {_BIP} FROM hits h
        JOIN labels_2b d ON d.game_str = h.game_str AND d.play_id = h.play_id
        WHERE batter_result = '2B' AND d.base_state IS NOT NULL""", ("hits", "labels_2b")),
}

def _sets(spark, sf, *names):
    return outcomes.outcome_sets(fixture.derived(spark, sf), fixture.double_labels(spark, sf), names)


def _folds_sql(name):
    rows, need = SETS[name]
    return tracking_sql(f"""SELECT a.algorithm, f.fold, f.game_str, f.play_id,
        f.label::VARCHAR AS label, 1::DOUBLE AS total
    FROM (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY
            ((substr(game_str, 2)::BIGINT * 1000 + play_id) % 1000003 * 7919) % 1000003,
            game_str, play_id) - 1) % 5 AS INTEGER) AS fold FROM ({rows})) f,
        (SELECT unnest({['boost', 'forest', 'lasso', 'ridge'] + ['logit'] * (name == 'steals')})
            AS algorithm) a""", *need)


def _register(name):
    """The validation rows that the fits of a set were scored on, each with its fold."""

    def rows(spark, sf):
        _, scores = outcomes.compare(_sets(spark, sf, name)[name], game_key())
        chances = [F.col(f"`{c}`") for c in scores.columns if c.startswith("p_")]
        return scores.select(
            "algorithm", "fold", *PLAY, F.col("label").cast("string").alias("label"),
            F.round(sum(chances[1:], chances[0]), 9).alias("total"))

    check(_folds_sql(name), name=f"scored_{name}")(rows)


for _name in SETS:
    _register(_name)


@check()
def compare_models(spark, sf):
    """All algorithms on the steals: AUC of every fold, and the report over the folds."""
    aucs, _ = outcomes.compare(_sets(spark, sf, "steals")["steals"], game_key())
    aucs = materialise(aucs)
    return aucs.join(models.cv_report(aucs, trees="trees"), "algorithm").drop("repeat")


def _design_sql(name):
    """One row per fold and play: medians, weights and index as the fits get them."""
    rows, need = SETS[name]
    features = {"steals": outcomes.STEAL_FEATURES, "outs": outcomes.BIP_FEATURES}[name]
    filled = ", ".join(f"round(coalesce({c}, (SELECT median(t.{c}) FROM train t WHERE t.fold = e.fold)), 6)"
                       f" AS {c}" for c in features)
    return tracking_sql(f""", own AS (
        SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY
            ((substr(game_str, 2)::BIGINT * 1000 + play_id) % 1000003 * 7919) % 1000003,
            game_str, play_id) - 1) % 5 AS INTEGER) AS mine FROM ({rows})),
    every AS (SELECT own.*, f.fold, own.mine = f.fold AS val,
        CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS index
        FROM own, (SELECT unnest(range(5))::INTEGER AS fold) f),
    train AS (SELECT * FROM every WHERE NOT val),
    sizes AS (SELECT fold, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY fold) AS whole,
        count(*) OVER (PARTITION BY fold) AS classes FROM train GROUP BY fold, label)
    SELECT e.fold, e.val, e.game_str, e.play_id, e.index,
        round(s.whole / (s.classes * s.n)::DOUBLE, 6) AS balanced,
        round(CASE WHEN s.classes = 2 AND e.index = 1 THEN (s.whole - s.n) / s.n::DOUBLE ELSE 1 END, 6)
            AS positive, {filled}
    FROM every e JOIN sizes s ON s.fold = e.fold AND s.label = e.label""", *need)


def _design(spark, sf, name):
    of = _sets(spark, sf, name)[name]
    rows = of.design(game_key()).rows
    return rows.select("fold", "val", "id.*", "index", *[
        F.round(c, 6).alias(c) for c in ("balanced", "positive", *of.features)])


@check(_design_sql("steals"))
def design_steals(spark, sf):
    """The stored table that all fits of a comparison read, two classes."""
    return _design(spark, sf, "steals")


@check(_design_sql("outs"))
def design_outs(spark, sf):
    """The same for more than two classes."""
    return _design(spark, sf, "outs")


@check(tracking_sql("SELECT game_str, play_id, 1::DOUBLE AS total FROM (" + SETS["doubles"][0] + ")",
                    *SETS["doubles"][1]))
def fit_forest(spark, sf):
    """The whole forest, on the set that it is fitted to."""
    of = _sets(spark, sf, "doubles")["doubles"]
    return _totals(of.rows, models.fit_forest(of.rows, of.features, of.label), PLAY)


@check("""SELECT unnest(['outs', 'singles', 'doubles']) AS model, 4::BIGINT AS features,
    100::DOUBLE AS total, 0::BIGINT AS negative""")
def importance_totals(spark, sf):
    """Shares of the three reports: one per feature, none negative, 100 together."""
    return _importances(spark, sf).groupBy("model").agg(
        F.count_distinct("feature").alias("features"),
        F.round(F.sum("importance"), 6).alias("total"),
        F.count_if(F.col("importance") < 0).alias("negative"))


def _importances(spark, sf):
    sets = _sets(spark, sf, "outs", "singles", "doubles")
    found = None
    for name, of in sets.items():
        if name == "doubles":
            model = models.fit_forest(of.rows, of.features, of.label)
        else:
            model = models.fit_logit(of.rows, of.features, of.label, name == "outs", each_class=True)
        rows = models.importance(spark, model).withColumn("model", F.lit(name))
        found = rows if found is None else found.unionByName(rows)
    return found


@check()
def importance(spark, sf):
    """Outs by an L1 fit, singles by an L2 fit, doubles by the forest."""
    return _importances(spark, sf)


# -- payoffs -------------------------------------------------------------------------

_PARTS = ["l_quantity", "l_discount + 0.01::DOUBLE", "l_tax + 0.01::DOUBLE",
          "l_linenumber::DOUBLE"]


def _share(i, n):
    return f"({_PARTS[i]}) / (" + " + ".join(f"({p})" for p in _PARTS[:n]) + ")"


def _change(values, n):
    return " + ".join(f"{_share(i, n)} * ({v}::DOUBLE - 0.836::DOUBLE)"
                      for i, v in enumerate(values))


@check(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(p, 5) AS pickoff_prob,
    round(s, 5) AS steal_prob, round(0.0016296::DOUBLE - p * 0.596::DOUBLE, 5) AS pickoff_payoff,
    round(stay, 5) AS pitch_stay_payoff,
    round(0.6486::DOUBLE * (s * (1.03::DOUBLE - 0.836::DOUBLE)
        + (1 - s) * (0.24::DOUBLE - 0.836::DOUBLE)) + stay, 5) AS pitch_steal_payoff,
    round(o, 5) AS bip_out_payoff, round(h, 5) AS bip_single_payoff, round(d, 5) AS bip_double_payoff
FROM (SELECT *, 0.1125::DOUBLE * o + 0.0354::DOUBLE * h + 0.0166::DOUBLE * d
        + 0.021329803603828152::DOUBLE AS stay
    FROM (SELECT *, l_discount AS p, l_quantity / 50 AS s,
        {_change([0.0961, 0.829, 0.536, 0.307], 4)} AS o,
        {_change([0.407, 1.64, 1.33], 3)} AS h, {_change([0.536, 2.03, 1.83], 3)} AS d
        FROM lineitem))""")
def payoffs(spark, sf):
    """Probabilities made of normalised columns."""
    rows = lines(spark, sf)
    parts = [F.col("l_quantity"), F.col("l_discount") + F.lit(0.01), F.col("l_tax") + F.lit(0.01),
             F.col("l_linenumber").cast("double")]

    def shares(names):
        whole = sum(parts[1:len(names)], parts[0])
        return {c: parts[i] / whole for i, c in enumerate(names)}

    return pay.payoffs(
        rows, F.col("l_discount"), F.col("l_quantity") / 50, shares(list(pay.OUT_VALUES)),
        shares(list(pay.SINGLE_VALUES)), shares(list(pay.DOUBLE_VALUES)), LINE)


@check()
def payoff_scenarios(spark, sf):
    return pay.payoff_scenarios(
        fixture.derived(spark, sf), fixture.double_labels(spark, sf))
