"""Gradient boosted trees for several folds and classes in the same passes over stored rows.

Spark's own boosting knows two classes and stops at the first round without gain. Here a round
grows one tree per class on the softmax gradient (one tree on the logistic gradient for two
classes), for every fold at once, and boosting goes on until the validation score has not
improved for ``patience`` rounds; the best prefix is kept.

Features are cut into at most ``BINS`` bins. Rows of one fold, label and weight that lie in the
same bins of all features are the same to a tree, so they are counted first and their gradients
taken that many times: what is read in every pass are the distinct ones (cells).

A level of all trees of a round is one pass: tasks sum gradient and curvature per (fold, class,
node, feature, bin) over their cells, the sums are added by a shuffle, and the driver takes the
best split of each node from them. That table has folds * classes * nodes * features * bins rows,
whatever the number of rows of the data. Leaves take Newton steps. Margins are written every
``BLOCK`` rounds and cached in between, so a lost executor costs no more than reading them again;
tasks add the trees grown since. If no fold has more than ``ROWS_PER_TASK`` cells, the share of
one task in these passes, there is nothing to add up between tasks, and each fold's rounds are
grown in one task by the same steps.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadline.operators.ranking import ranges_for, roc_auc
from leadline.session import importable, materialise, replaced, scratch_path

BINS, BLOCK = 64, 20
ROWS_PER_TASK = 50_000
MERGED = 4                # sums of so few tasks are added on the driver, of more by a shuffle
NEVER = 255               # a limit that sends every row to the left
KNOWN = 200_000           # cells whose chances a task that scores rows remembers
FOLD_TASKS = 32           # folds that are grown by themselves are dealt over so many tasks

ROW = "fold int, val boolean, label int, weight double, bins binary, n bigint, margin array<double>"


@dataclass
class Boosted:
    """Trees of one fold. Axis 0 is the round, axis 1 the class, axis 2 the node or leaf."""

    cuts: list[list[float]]     # edges of each feature; a value's bin is the number of edges <= it
    classes: int
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    gain: np.ndarray            # total gain by feature
    scores: list[float] = field(default_factory=list)   # validation score after each round

    @property
    def getNumTrees(self) -> int:
        return len(self.value)

    def bins(self, columns: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(np.array(c), x, "right").astype(np.uint8)
                         for c, x in zip(self.cuts, columns)], axis=1)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return added(np.zeros((len(bins), self.value.shape[1])), bins,
                     (self.feature, self.limit, self.value))

    def chances(self, columns: list[np.ndarray]) -> np.ndarray:
        """Probability of each class, a row for each row of the feature columns."""
        return probabilities(self.margins(self.bins(columns)))

    def remembering(self) -> Callable:
        """``chances`` for the batches of a task: rows in the same bins are put through the trees
        once, and not again while no more than ``KNOWN`` cells have been met."""
        cells, found = np.zeros(0, f"S{max(1, len(self.cuts))}"), np.zeros((0, self.classes))

        def chances(columns: list[np.ndarray]) -> np.ndarray:
            nonlocal cells, found
            bins = self.bins(columns)
            cell, first, at = np.unique(bins.view(cells.dtype).ravel(), return_index=True,
                                        return_inverse=True)
            new = ~np.isin(cell, cells)
            if new.any():
                if len(cells) + new.sum() > KNOWN:
                    cells, found, new = cells[:0], found[:0], np.ones(len(cell), bool)
                cells = np.concatenate([cells, cell[new]])
                found = np.concatenate([found, probabilities(self.margins(bins[first[new]]))])
                order = np.argsort(cells)
                cells, found = cells[order], found[order]
            return found[np.searchsorted(cells, cell)][at.ravel()]

        return chances


def places(bins: np.ndarray, feature: np.ndarray, limit: np.ndarray, depth: int) -> np.ndarray:
    """Which node of the level ``depth`` each row reaches in one tree."""
    row, at = np.arange(len(bins)), np.zeros(len(bins), np.int64)
    for level in range(depth):
        node = at + (1 << level) - 1
        at = 2 * at + (bins[row, feature[node]] > limit[node])
    return at


def added(margin: np.ndarray, bins: np.ndarray, trees) -> np.ndarray:
    """The margins with the steps of some rounds of trees added."""
    feature, limit, value = trees
    depth = int(value.shape[2]).bit_length() - 1
    for r in range(len(value)):
        for c in range(value.shape[1]):
            margin[:, c] += value[r, c][places(bins, feature[r, c], limit[r, c], depth)]
    return margin


def probabilities(margin: np.ndarray) -> np.ndarray:
    if margin.shape[1] == 1:
        p = 1 / (1 + np.exp(-margin[:, 0]))
        return np.stack([1 - p, p], axis=1)
    e = np.exp(margin - margin.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(margin: np.ndarray, label: np.ndarray, weight: np.ndarray):
    """First and second derivative of the weighted loss by each margin."""
    p = probabilities(margin)
    if margin.shape[1] == 1:
        p, hit = p[:, 1:], (label == 1)[:, None]
    else:
        hit = label[:, None] == np.arange(margin.shape[1])
    return (p - hit) * weight[:, None], np.maximum(p * (1 - p), 1e-16) * weight[:, None]


def _cells(batch: pa.RecordBatch):
    """fold, val, label, weight, bins and number of the cells of a batch as arrays."""
    fold, val, label, weight = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
    bins = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(len(fold), -1)
    return fold, val, label, weight, bins, batch.column(5).to_numpy(zero_copy_only=False)


def _columns(batch: pa.RecordBatch, trees: int):
    """The same and the margin of each cell."""
    cells = _cells(batch)
    margin = np.array(batch.column(6).flatten().to_numpy(zero_copy_only=False))
    return *cells, margin.reshape(len(cells[0]), trees)


def level_sums(x: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, nodes: int):
    """Summed gradient and curvature of one tree by (node, feature, bin), as one line."""
    wide = x.shape[1] * BINS
    cell = (at[:, None] * wide + np.arange(x.shape[1]) * BINS + x).ravel()
    return [np.bincount(cell, np.repeat(part, x.shape[1]), nodes * wide) for part in (g, h)]


def _grown(rows: DataFrame, state: dict):
    """Per (cell): summed gradient and curvature at the current level of all growing trees."""
    trees, wide = state["trees"], state["features"] * BINS
    nodes = 1 << state["level"]

    def add(batches):
        sums: dict = {}
        for batch in batches:
            fold, val, label, weight, bins, n, margin = _columns(batch, trees)
            for f in np.unique(fold[~val]):
                if f not in state["growing"]:
                    continue
                own = np.flatnonzero((fold == f) & ~val)
                x = bins[own]
                m = added(margin[own], x, state["block"][f])
                g, h = gradients(m, label[own], weight[own] * n[own])
                for c in range(trees):
                    feature, limit = state["growing"][f]
                    at = places(x, feature[c], limit[c], state["level"])
                    for k, total in enumerate(level_sums(x, g[:, c], h[:, c], at, nodes)):
                        sums[f, c, k] = sums.get((f, c, k), 0) + total
        for f, c in sorted({key[:2] for key in sums}):
            g, h = sums[f, c, 0], sums[f, c, 1]
            used = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays(
                [pa.array((int(f) * trees + c) * nodes * wide + used), pa.array(g[used]),
                 pa.array(h[used])], names=["cell", "g", "h"])

    parts = rows.mapInArrow(add, "cell bigint, g double, h double")
    if state["tasks"] > MERGED:
        parts = parts.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    return parts.toArrow()


def best_splits(g: np.ndarray, h: np.ndarray, l2: float, least: float):
    """Best split of each node from sums of shape (nodes, features, bins).

    Returns feature, limit, gain and the sums (g, h) of both sides. Gains are compared to nine
    digits, so the order in which sums were added does not choose between equal splits.
    """
    left_g, left_h = g.cumsum(2), h.cumsum(2)
    all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h

    def worth(a, b):
        return a * a / np.maximum(b + l2, 1e-12)

    gain = worth(left_g, left_h) + worth(right_g, right_h) - worth(all_g, all_h)
    gain = np.where((left_h >= least) & (right_h >= least), gain, 0.0)
    flat = gain.reshape(len(g), -1)
    near = flat >= flat.max(1, keepdims=True) * (1 - 1e-9)
    at = near.argmax(1)
    node = np.arange(len(g))
    feature, limit = at // g.shape[2], at % g.shape[2]
    split = flat[node, at] > 1e-9
    pick = (node, feature, limit)
    sides = [np.stack([np.where(split, l[pick], t[:, 0, 0]), np.where(split, r[pick], 0.0)], 1)
             for l, r, t in ((left_g, right_g, all_g), (left_h, right_h, all_h))]
    return (np.where(split, feature, 0), np.where(split, limit, NEVER),
            np.where(split, flat[node, at], 0.0), *sides)


def _round(folds, trees: int, sums: Callable, depth: int, step: float, l2: float, least: float,
           gains: dict) -> dict:
    """One round of trees of every growing fold: fold -> (feature, limit, value).

    ``sums(growing, level)`` gives gradient and curvature by (fold, class, node, feature, bin).
    """
    inner, leaf = (1 << depth) - 1, {}
    growing = {f: (np.zeros((trees, inner), np.int64), np.full((trees, inner), NEVER))
               for f in folds}
    for level in range(depth):
        nodes = 1 << level
        g, h = sums(growing, level)
        for f, (feature, limit) in growing.items():
            for c in range(trees):
                here = slice(nodes - 1, 2 * nodes - 1)
                feature[c, here], limit[c, here], gain, side_g, side_h = best_splits(
                    g[f][c], h[f][c], l2, least)
                np.add.at(gains[f], feature[c, here], gain)
                if level == depth - 1:
                    value = -step * side_g / np.maximum(side_h + l2, 1e-12)
                    leaf[f, c] = value.ravel()
    return {f: (*growing[f], np.stack([leaf[f, c] for c in range(trees)])) for f in growing}


def _passes(rows: DataFrame, state: dict) -> Callable:
    """The sums of a level over all rows, by one Spark job."""
    trees, features = state["trees"], state["features"]

    def sums(growing, level):
        nodes = 1 << level
        found = _grown(rows, state | {"growing": growing, "level": level})
        g, h = (np.zeros((max(growing) + 1) * trees * nodes * features * BINS) for _ in range(2))
        cell = found.column("cell").to_numpy()
        np.add.at(g, cell, found.column("g").to_numpy())
        np.add.at(h, cell, found.column("h").to_numpy())
        return [s.reshape(-1, trees, nodes, features, BINS) for s in (g, h)]

    return sums


def _stacked(rounds: list):
    return tuple(np.stack([r[k] for r in rounds]) for k in range(3))


def _refreshed(rows: DataFrame, state: dict) -> DataFrame:
    """The rows with the margins after the trees of the block."""
    trees = state["trees"]

    def add(batches):
        for batch in batches:
            fold, *_, bins, _, margin = _columns(batch, trees)
            for f, block in state["block"].items():
                own = np.flatnonzero(fold == f)
                margin[own] = added(margin[own], bins[own], block)
            at = pa.array(np.arange(len(fold) + 1, dtype=np.int32) * trees)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], pa.ListArray.from_arrays(at, pa.array(margin.ravel()))],
                names=batch.schema.names)

    return rows.mapInArrow(add, ROW)


def row_scores(margin: np.ndarray, label: np.ndarray, metric: str) -> np.ndarray:
    """What a validation row adds: its chance of class 1, or the log of that of its class."""
    p = probabilities(margin)
    if metric == "auc":
        return p[:, 1]
    return np.log(np.maximum(p[np.arange(len(label)), label], 1e-15))


def _validation(rows: DataFrame, state: dict, metric: str, rounds: int, n: int) -> dict:
    """fold -> scores (greater is better) after each round of the block; n rows in all."""
    trees = state["trees"]

    def scored(batches):
        for batch in batches:
            fold, val, label, _, bins, n, margin = _columns(batch, trees)
            for f, block in state["block"].items():
                own = np.flatnonzero((fold == f) & val)
                m, x, y = margin[own], bins[own], label[own]
                for r in range(rounds):
                    m = added(m, x, tuple(part[r:r + 1] for part in block))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(y), f, np.int32)),
                         pa.array(np.full(len(y), r, np.int32)),
                         pa.array((y == 1).astype(np.int32)), pa.array(n[own]),
                         pa.array(row_scores(m, y, metric))],
                        names=["fold", "round", "hit", "n", "score"])

    each = rows.where("val").mapInArrow(
        scored, "fold int, round int, hit int, n bigint, score double")
    if metric == "auc":
        found = roc_auc(each, "hit", "score", ["fold", "round"], ranges_for(n * rounds), "n")
    else:
        found = each.groupBy("fold", "round").agg(
            (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("auc"))
    got = {(r["fold"], r["round"]): r["auc"] for r in found.collect()}   # folds * rounds rows
    return {f: [got.get((f, r)) for r in range(rounds)] for f in state["block"]}


def counted_auc(hit: np.ndarray, score: np.ndarray, n: np.ndarray) -> float | None:
    """``roc_auc`` of one group whose rows stand for ``n`` equal ones each."""
    at = np.unique(score, return_inverse=True)[1]
    pos, neg = (np.bincount(at, n * flag) for flag in (hit, ~hit))
    pairs = pos.sum() * neg.sum()
    return float((pos * (neg.cumsum() - neg / 2)).sum() / pairs) if pairs else None


def _alone(cells: tuple, trees: int, shape: tuple, rounds: int, patience: int | None, metric: str,
           block: int) -> tuple:
    """(rounds of trees, validation scores, gain by feature) of one fold from all its cells.

    The same steps as the passes of ``boost``, also the block after which it looks at patience.
    """
    _, val, label, weight, bins, n = cells
    x, y, w = bins[~val], label[~val], (weight * n)[~val]
    margin, checked = np.zeros((len(x), trees)), np.zeros((val.sum(), trees))
    grown, scores, gains = [], [], {0: np.zeros(bins.shape[1])}
    while len(grown) < rounds:
        for _ in range(min(block, rounds - len(grown))):
            g, h = gradients(margin, y, w)

            def sums(growing, level):
                nodes, (feature, limit) = 1 << level, growing[0]
                each = [level_sums(x, g[:, c], h[:, c], places(
                    x, feature[c], limit[c], level), nodes) for c in range(trees)]
                return [[[one[k].reshape(nodes, -1, BINS) for one in each]] for k in range(2)]

            own = _round([0], trees, sums, *shape, gains)[0]
            grown.append(own)
            tree = _stacked([own])
            margin = added(margin, x, tree)
            if patience is not None:
                checked = added(checked, bins[val], tree)
                score, many = row_scores(checked, label[val], metric), n[val]
                scores.append(None if not len(many) else
                              counted_auc(label[val] == 1, score, many) if metric == "auc" else
                              float((score * many).sum() / many.sum()))
        if patience is not None and best_prefix(scores, patience)[1]:
            break
    return grown, scores, gains[0]


def _grown_alone(cells: DataFrame, folds: list, *settings) -> dict:
    """fold -> what ``_alone`` returns, each fold in a task of its own."""

    def grow(part: pa.Table) -> pa.Table:
        own = _cells(part.combine_chunks().to_batches()[0])
        return pa.table({"fold": pa.array([int(own[0][0])], pa.int32()),
                         "model": [pickle.dumps(_alone(own, *settings))]})

    # the number of tasks is stated, so that adaptive execution does not put the folds together
    found = cells.repartition(min(FOLD_TASKS, max(1, len(folds) ** 2)), "fold").groupBy(
        "fold").applyInArrow(grow, "fold int, model binary")
    return {r["fold"]: pickle.loads(r["model"]) for r in found.collect()}


def best_prefix(scores: list, patience: int) -> tuple[int, bool]:
    """(rounds to keep, is it settled): boosting stops ``patience`` rounds after the best one.

    The first of equal scores counts. A missing score (one class only) is no gain; without any
    score all rounds stay.
    """
    best, at = None, 0
    for k, score in enumerate(scores):
        if score is not None and (best is None or score > best):
            best, at = score, k + 1
        if best is not None and k + 1 - at >= patience:
            return at, True
    return (at or len(scores)), False


def cut_points(df: DataFrame, features) -> list[list[float]]:
    """Edges that cut each feature into at most ``BINS`` bins of about equal size."""
    shares = [k / BINS for k in range(1, BINS)]
    found = df.approxQuantile(list(features), shares, 0.25 / BINS)
    return [sorted(set(c)) for c in found]


def binned(features, cuts) -> Column:
    """One byte for each feature: how many of its edges are at or below the value."""

    def below(name: str, edges: list) -> Column:
        value = F.col(name)
        known = F.array(*[F.lit(float(e)) for e in edges]) if edges else F.lit([]).cast("array<double>")
        return F.size(F.filter(known, lambda e: e <= value))

    return F.unhex(F.concat(*[
        F.lpad(F.hex(below(c, edges)), 2, "0") for c, edges in zip(features, cuts)]))


def boost(rows: DataFrame, features, classes: int, rounds: int, depth: int = 5,
          step: float = 0.1, l2: float = 1.0, least: float = 1.0, patience: int | None = None,
          metric: str | None = None, block: int = BLOCK) -> dict[int, Boosted]:
    """fold -> trees, for every value of ``fold``.

    ``rows`` holds fold, val, label (0, 1, ...), weight and the features without nulls; rows
    with ``val`` are not trained on. With ``patience`` they stop a fold, by ROC-AUC for two
    classes and by log loss for more unless ``metric`` names one of "auc", "logloss".
    """
    spark = rows.sparkSession
    importable(spark)
    metric = metric or ("auc" if classes == 2 else "logloss")
    trees = 1 if classes == 2 else classes
    cuts = cut_points(rows.where("not val"), features)
    cells = materialise(rows.select(
        F.col("fold").cast("int"), "val", F.col("label").cast("int"), "weight",
        binned(features, cuts).alias("bins")).groupBy("fold", "val", "label", "weight", "bins").agg(
        F.count(F.lit(1)).alias("n")))
    sizes = {r["fold"]: (r["cells"], r["n"]) for r in cells.groupBy("fold").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n")).collect()}
    folds = list(sizes)
    empty = (np.zeros((0, trees, (1 << depth) - 1), np.int64),) * 2 + (
        np.zeros((0, trees, 1 << depth)),)
    grown = {f: [] for f in folds}
    scores: dict = {f: [] for f in folds}
    gains = {f: np.zeros(len(features)) for f in folds}
    if max((size for size, _ in sizes.values()), default=0) <= ROWS_PER_TASK:
        for f, found in _grown_alone(cells, folds, trees, (depth, step, l2, least), rounds,
                                     patience, metric, block).items():
            grown[f], scores[f], gains[f] = found
        return _models(cuts, classes, grown, scores, gains, patience, empty)
    n = sum(rows for _, rows in sizes.values())
    tasks = -(-sum(size for size, _ in sizes.values()) // ROWS_PER_TASK)
    path = scratch_path(spark, "margins")
    cells.withColumn("margin", F.array(*[F.lit(0.0)] * trees)).repartition(tasks).write.parquet(path)
    now = spark.read.schema(ROW).parquet(path).persist()   # read once per level
    open_, done = set(folds), 0
    while open_ and done < rounds:
        size = min(block, rounds - done)
        own: dict = {f: [] for f in open_}
        for _ in range(size):
            state = {"trees": trees, "features": len(features), "tasks": tasks,
                     "block": {f: _stacked(own[f]) if own[f] else empty for f in open_}}
            for f, tree in _round(open_, trees, _passes(now, state), depth, step, l2, least,
                                  gains).items():
                own[f].append(tree)
        state["block"] = {f: _stacked(own[f]) for f in open_}
        for f in open_:
            grown[f] += own[f]
        done += size
        if patience is not None:
            for f, found in _validation(now, state, metric, size, n).items():
                scores[f] += found
            open_ = {f for f in open_ if not best_prefix(scores[f], patience)[1]}
        if open_ and done < rounds:
            old, (path, now) = now, replaced(spark, path, _refreshed(now, state), ROW)
            old.unpersist()
            now = now.persist()
    now.unpersist()
    return _models(cuts, classes, grown, scores, gains, patience, empty)


def _models(cuts: list, classes: int, grown: dict, scores: dict, gains: dict,
            patience: int | None, empty: tuple) -> dict[int, Boosted]:
    """The best prefix of each fold's rounds."""
    models = {}
    for f in grown:
        keep = len(grown[f]) if patience is None else best_prefix(scores[f], patience)[0]
        models[f] = Boosted(cuts, classes, *(_stacked(grown[f][:keep]) if keep else empty),
                            gains[f], scores[f])
    return models
