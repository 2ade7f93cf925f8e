"""The registered queries ask for the whole fits; the fits run here are small stand-ins."""

import pytest

from leadline.checks.all import QUERIES
from leadline.plans import models

SMALL = {"RandomForestClassifier": dict(numTrees=2, maxDepth=2), "LogisticRegression": dict(maxIter=2)}
FOREST = ("RandomForestClassifier", 1000, 30)
LINEAR = ("LogisticRegression", 100, None)
BOOST = ("boost", 1000, 100)   # stopped by patience
FINAL = ("boost", 1, None)     # the stand-in's best number of rounds


@pytest.mark.parametrize("name, want", [
    ("fit_forest", {FOREST: 1}), ("fit_boost", {BOOST: 1}), ("fit_boost_multi", {BOOST: 1}),
    ("score", {LINEAR: 1}), ("importance", {LINEAR: 2, FOREST: 1}),
    ("scored_steals", {BOOST: 1, FOREST: 5, LINEAR: 15}),
    ("compare_models", {BOOST: 1, FOREST: 5, LINEAR: 15}),
    ("scored_outs", {BOOST: 1, FOREST: 5, LINEAR: 10}),
    ("payoff_scenarios", {BOOST: 2, FINAL: 2, FOREST: 1, LINEAR: 2})])
def test_settings_of_registered_fits(spark, monkeypatch, name, want):
    asked = {}

    def note(*what):
        asked[what] = asked.get(what, 0) + 1

    def recording(kind):
        real = getattr(models, kind)

        def make(**settings):
            note(kind, settings.get("numTrees", settings.get("maxIter")), settings.get("maxDepth"))
            return real(**{**settings, **SMALL[kind]})

        return make

    real = models.boost

    def boost(rows, features, classes, rounds, depth=5, step=0.1, patience=None, **settings):
        note("boost", rounds, patience)
        return real(rows, features, classes, 1, 2, step, patience=patience, **settings)

    for kind in SMALL:
        monkeypatch.setattr(models, kind, recording(kind))
    monkeypatch.setattr(models, "boost", boost)
    QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert asked == want
