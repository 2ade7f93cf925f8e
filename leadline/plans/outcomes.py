"""The five labelled outcome sets, each with its features, label and the fits it is given."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadline.functions.codes import PLAY
from leadline.operators.relational import overlay_labels
from leadline.plans import models
from leadline.plans.balls_in_play import BIP_FEATURES, bip_set, training_rows
from leadline.plans.leads import KINEMATIC
from leadline.plans.moments import release_time
from leadline.plans.people import pop_time, sprint_speed
from leadline.plans.pickoffs import pickoff_set
from leadline.plans.steals import STEAL_FEATURES, steal_set
from leadline.session import materialise
from leadline.sources.tracking import Tracking

PICKOFF_FEATURES = [*KINEMATIC, "sprint_speed"]

HITS = {"outs": "Out", "singles": "1B", "doubles": "2B"}   # the sets of balls in play
SETS = ("pickoffs", "steals", *HITS)


def play_key() -> Column:
    """An integer for each play that orders plays within a class for the folds."""
    return F.crc32(F.concat_ws("|", *PLAY).cast("binary"))


@dataclass
class Measures:
    """Stored tables that the sets share: sprint speeds, pop times, releases of all plays.

    Pop times are made for steals only. Sets of one kind of play share no releases: they are
    found among the frames of these plays alone.
    """

    speeds: DataFrame
    pops: DataFrame | None
    releases: DataFrame | None

    @classmethod
    def of(cls, t: Tracking, names=SETS) -> "Measures":
        kinds = {"balls in play" if n in HITS else n for n in names}
        return cls(materialise(sprint_speed(t)),
                   materialise(pop_time(t)) if "steals" in kinds else None,
                   materialise(release_time(t)) if len(kinds) > 1 else None)


@dataclass
class OutcomeSet:
    """``rows`` has one row per play; ``weighted`` and ``plain`` are for the logistic fits."""

    rows: DataFrame
    features: list
    label: str
    weighted: str | None = "balanced"
    plain: bool = False

    def design(self, key: Column | None = None, folds: int = models.FOLDS, seed: int = 0):
        return models.design(self.rows, self.features, self.label,
                             play_key() if key is None else key, PLAY, folds, seed, keep=PLAY)

    def fits(self, **settings) -> dict:
        return models.algorithms(weighted=self.weighted, plain=self.plain, **settings)


def outcome_sets(t: Tracking, double_labels: DataFrame | None = None,
                 names=SETS, measures: Measures | None = None) -> dict:
    """Name to stored set, for the names asked for; they share one table of each measure.

    ``double_labels`` (play keys, base_state) tells doubles on which the runner scored from
    those on which they were out; without it doubles keep their base state.
    """
    own, found = measures or Measures.of(t, names), {}
    speeds, releases = own.speeds, own.releases
    if "pickoffs" in names:
        found["pickoffs"] = OutcomeSet(materialise(pickoff_set(t, speeds, releases)), PICKOFF_FEATURES,
                                       "pickoff_result", weighted=None)
    if "steals" in names:
        found["steals"] = OutcomeSet(materialise(steal_set(t, speeds, own.pops, releases)), STEAL_FEATURES,
                                     "outcome", plain=True)
    if any(n in names for n in HITS):
        bip = materialise(bip_set(t, speeds, releases))
        for name, result in HITS.items():
            if name in names:
                rows = training_rows(bip, result)
                if name == "doubles" and double_labels is not None:
                    rows = materialise(overlay_labels(rows, double_labels, PLAY, "base_state"))
                found[name] = OutcomeSet(rows, BIP_FEATURES, "base_state")
    return found


def compare(of: OutcomeSet, key: Column | None = None, folds: int = models.FOLDS,
            repeats: int = 1, **settings) -> tuple[DataFrame, DataFrame]:
    """(aucs, scores): the score of every fit on every fold, and the validation rows behind it."""
    scores, sizes, classes = None, [], []
    for repeat in range(repeats):
        table = of.design(key, folds, repeat)
        classes = table.classes
        rows, trees = models.cross_scores(table, of.fits(**settings), repeat)
        scores = rows if scores is None else scores.unionByName(rows)
        sizes += trees
    return models.fold_aucs(scores, classes, sizes), scores.select(
        "algorithm", "repeat", "fold", "id.*", "label",
        *[F.col(f"s{i}").alias(f"p_{c}") for i, c in enumerate(classes)])
