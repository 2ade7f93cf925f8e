"""Run-value payoffs of leads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadline.operators.ranking import medians
from leadline.plans.leads import lead_profile, lead_scenarios
from leadline.plans.models import (
    PATIENCE, TREES, Fitted, best_rounds, chance, fit_boost, fit_forest, fit_logit, side_by_side,
)
from leadline.plans.outcomes import Measures, OutcomeSet, outcome_sets
from leadline.session import materialise
from leadline.sources.tracking import Tracking

# Run expectancy of the states, by class name, and the weights of the terms.
START = 0.836
OUT_VALUES = {"000": 0.0961, "001": 0.829, "010": 0.536, "100": 0.307}
SINGLE_VALUES = {"100": 0.407, "101": 1.64, "110": 1.33}
DOUBLE_VALUES = {"010(0)": 0.536, "010(1)": 2.03, "011": 1.83}
PICKOFF_BASE, PICKOFF_COST = 0.0016296, 0.596
OUT_WEIGHT, SINGLE_WEIGHT, DOUBLE_WEIGHT = 0.1125, 0.0354, 0.0166
PITCH_BASE = 0.021329803603828152
STEAL_WEIGHT, STEAL_SAFE, STEAL_OUT = 0.6486, 1.03, 0.24
DIGITS = 5

# The worked examples, as (example, lead, set, share, speed, pop time);
# no speed or pop time means the median over all runners or catchers.
EXAMPLES = [
    ("four_branch", "very_safe", "steals", 0.25, None, None),
    ("four_branch", "safe", "steals", 0.27, None, None),
    ("four_branch", "aggressive", "steals", 0.55, None, None),
    ("four_branch", "very_aggressive", "steals", 0.6, None, None),
    ("two_branch", "safe", "steals", 0.27, None, None),
    ("two_branch", "aggressive", "steals", 0.55, None, None),
    ("median", "median", "leads", 0.5, None, None),
    ("fast_runner", "safe", "steals", 0.25, 31.5, 1.9),
    ("fast_runner", "aggressive", "steals", 0.55, 31.5, 1.9),
    ("slow_runner", "very_safe", "leads", 0.11, None, None),
    ("slow_runner", "safe", "steals", 0.25, None, None),
    ("three_branch", "safe", "steals", 0.25, None, None),
    ("three_branch", "median", "leads", 0.5, None, None),
    ("three_branch", "aggressive", "steals", 0.6, None, None),
]


def expected_change(chances: dict, values: dict, start: float = START) -> Column:
    """Sum over classes of probability times change in run value."""
    return sum((chances[c] * F.lit(v - start) for c, v in values.items()), F.lit(0.0))


def payoffs(df: DataFrame, pickoff: Column, steal: Column, outs: dict, singles: dict,
            doubles: dict, keep=()) -> DataFrame:
    """Eight rounded numbers for every row.

    ``pickoff`` is the chance of a pickoff, ``steal`` of a safe steal; the others map
    class names to chances.
    """
    terms = df.withColumns({
        "_pickoff": pickoff, "_steal": steal,
        "_out": expected_change(outs, OUT_VALUES),
        "_single": expected_change(singles, SINGLE_VALUES),
        "_double": expected_change(doubles, DOUBLE_VALUES),
    }).withColumn("_stay", (
        F.lit(OUT_WEIGHT) * F.col("_out") + F.lit(SINGLE_WEIGHT) * F.col("_single")
        + F.lit(DOUBLE_WEIGHT) * F.col("_double") + F.lit(PITCH_BASE)))
    run = F.col("_steal")
    gain = run * F.lit(STEAL_SAFE - START) + (F.lit(1.0) - run) * F.lit(STEAL_OUT - START)
    values = {
        "pickoff_prob": F.col("_pickoff"),
        "steal_prob": F.col("_steal"),
        "pickoff_payoff": F.lit(PICKOFF_BASE) - F.col("_pickoff") * F.lit(PICKOFF_COST),
        "pitch_stay_payoff": F.col("_stay"),
        "pitch_steal_payoff": F.lit(STEAL_WEIGHT) * gain + F.col("_stay"),
        "bip_out_payoff": F.col("_out"),
        "bip_single_payoff": F.col("_single"),
        "bip_double_payoff": F.col("_double"),
    }
    return terms.select(*keep, *[F.round(v, DIGITS).alias(n) for n, v in values.items()])


@dataclass
class OutcomeModels:
    pickoff: Fitted
    steal: Fitted
    outs: Fitted
    singles: Fitted
    doubles: Fitted


def fit_tuned(of: OutcomeSet, trees: int = TREES, patience: int = PATIENCE) -> Fitted:
    """Boosted on all rows, with the median of the folds' best numbers of rounds."""
    return fit_boost(of.rows, of.features, of.label, best_rounds(of.design(), trees, patience))


def fit_outcomes(sets: dict, trees: int = TREES, patience: int = PATIENCE,
                 forest: int = TREES) -> OutcomeModels:
    """The chosen model of each outcome; ``sets`` as ``outcome_sets`` gives them.

    Pickoffs and steals are boosted for as many rounds as cross-validation finds best, outs are
    L1 logistic, singles L2, doubles a forest.
    """

    def linear(name: str, l1: bool) -> Fitted:
        of = sets[name]
        return fit_logit(of.rows, of.features, of.label, l1, each_class=True)

    two = sets["doubles"]
    fits = dict(
        pickoff=lambda: fit_tuned(sets["pickoffs"], trees, patience),
        steal=lambda: fit_tuned(sets["steals"], trees, patience),
        outs=lambda: linear("outs", True), singles=lambda: linear("singles", False),
        doubles=lambda: fit_forest(two.rows, two.features, two.label, forest))
    return OutcomeModels(**side_by_side(two.rows.sparkSession, fits))


NAMES = ("pickoff", "steal", "outs", "singles", "doubles")


def with_chances(leads: DataFrame, models: OutcomeModels) -> DataFrame:
    """``chances_pickoff`` and so on: class probabilities of the five models, each row scored once."""
    for name in NAMES:
        leads = getattr(models, name).probabilities(leads, f"chances_{name}")
    return leads


def payoff_table(leads: DataFrame, models: OutcomeModels, keep=()) -> DataFrame:
    """Payoffs of every row of ``leads``: kinematics, sprint_speed, average_pop_time."""
    return payoffs(
        with_chances(leads, models), chance("chances_pickoff", 1), chance("chances_steal", 0),
        {c: chance("chances_outs", c) for c in OUT_VALUES},
        {c: chance("chances_singles", c) for c in SINGLE_VALUES},
        {c: chance("chances_doubles", c) for c in DOUBLE_VALUES}, keep)


def example_leads(sets: dict, speed: float, pop: float) -> DataFrame:
    """The worked examples as rows; ``sets`` maps a set name to a stored table."""
    tables = [
        lead_scenarios(df, sorted({e[3] for e in EXAMPLES if e[2] == name})).withColumn(
            "source", F.lit(name))
        for name, df in sets.items()
    ]
    quantiles = tables[0]
    for table in tables[1:]:
        quantiles = quantiles.unionByName(table)
    rows = [(e, l, s, p, float(v if v is not None else speed), float(q if q is not None else pop))
            for e, l, s, p, v, q in EXAMPLES]
    named = quantiles.sparkSession.createDataFrame(
        rows, "example string, lead string, source string, share double, "
              "sprint_speed double, average_pop_time double")
    return F.broadcast(named).join(quantiles, ["source", "share"])


def payoff_scenarios(t: Tracking, double_labels: DataFrame | None = None, trees: int = TREES,
                     patience: int = PATIENCE, forest: int = TREES, keep=()) -> DataFrame:
    """Payoffs of the worked examples, from tracking tables to run values.

    ``double_labels`` as for ``outcome_sets``. ``keep`` names more columns of the scored rows,
    such as the maps of probabilities (``chances_pickoff``, ...).
    """
    own = Measures.of(t)
    sets = outcome_sets(t, double_labels, measures=own)
    models = fit_outcomes(sets, trees, patience, forest)
    usual = example_leads(
        {"steals": sets["steals"].rows, "leads": materialise(lead_profile(t, own.releases))},
        medians(own.speeds, ["sprint_speed"])["sprint_speed"] or 0.0,
        medians(own.pops, ["average_pop_time"])["average_pop_time"] or 0.0)
    return payoff_table(usual, models, ["example", "lead", "source", "share", *keep])
