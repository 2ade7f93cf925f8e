"""Outcome models: data work around the fits, the fits, their comparison and scores.

Fits are ``pyspark.ml`` estimators. What comes back to the driver is model-sized: one
median, mean and deviation per feature, one count per class.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline.functions.scalars import title_label
from leadline.operators.ranking import (
    medians, quantile_table, roc_auc, roc_auc_ovr, stratified_folds,
)
from leadline.operators.relational import spread_join
from leadline.plans.boosting import Boosted, binned, boost
from leadline.plans.forests import Cells, Forest, fold_chances, stored_forest
from leadline.session import importable, materialise, scratch_path

# Folds, trees and patience of the full runs; forests grow as deep as Spark lets them.
FOLDS = 5
TREES = 1000
PATIENCE = 100
FOREST_DEPTH = 30

MOST_CLASSES = 100   # more distinct labels than this are a wrong column, not classes
SIDE_BY_SIDE = 4     # independent fits that are submitted at a time
FOREST_MB = 1024     # memory for the node statistics of one pass over the rows
FOREST_ROWS = 1000   # training rows of a forest in a task, each of which meets every tree, or more
FOREST_MOST = 10_000 # training rows up to which Spark grows a forest; of more, tasks grow whole trees
FOREST_CELLS = 4_000_000   # distinct rows of a fold that a task holds to grow trees, some 100 bytes each


# -- data work ---------------------------------------------------------------------

def drop_ids(df: DataFrame, columns) -> DataFrame:
    return df.drop(*columns)


def assemble(df: DataFrame, features, output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=output).transform(df)


def fill_medians(df: DataFrame, values: dict) -> DataFrame:
    """Replace nulls by given medians; a feature that had no value at all becomes 0."""
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(0.0 if m is None else float(m)))
        for c, m in values.items()})


def impute_median(train: DataFrame, features, *others: DataFrame) -> list[DataFrame]:
    """Exact medians of ``train`` put into it and into the other frames."""
    values = medians(train, features)
    return [fill_medians(df, values) for df in (train, *others)]


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("class_rows"))


def class_weights(df: DataFrame, label: str, mode: str = "balanced", positive=1,
                  output: str = "weight") -> DataFrame:
    """Row weights by class.

    ``balanced``: rows / (classes * rows of the class). ``positive``: negatives per
    positive for the positive class, 1 for the others.
    """
    sizes = class_sizes(df, label)
    if mode == "balanced":
        whole = sizes.agg((F.sum("class_rows") / F.count("*")).alias("r")).select("r").scalar()
        weight = whole / F.col("class_rows")
    elif mode == "positive":
        hit = F.col(label) == F.lit(positive)
        ratio = sizes.agg(
            F.sum(F.when(~hit, F.col("class_rows"))) / F.sum(F.when(hit, F.col("class_rows")))
        ).scalar()
        weight = F.when(hit, F.coalesce(ratio, F.lit(1.0))).otherwise(F.lit(1.0))
    else:
        raise ValueError(f"unknown mode {mode}")
    return spread_join(df, sizes.select(label, weight.alias(output)), [label], "left")


def encode_labels(df: DataFrame, label: str, output: str | None = None) -> DataFrame:
    """Number of the class in alphabetical order, from 0."""
    output = output or f"{label}_encoded"
    indexed = StringIndexer(
        inputCol=label, outputCol="_index", stringOrderType="alphabetAsc").fit(df).transform(df)
    return indexed.withColumn(output, F.col("_index").cast("int")).drop("_index")


def scaling(df: DataFrame, columns) -> dict:
    """Mean and population deviation per column, as numbers."""
    one = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns)
                   for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (one[f"m{i}"], one[f"s{i}"]) for i, c in enumerate(columns)}


def standardise(df: DataFrame, scale: dict) -> DataFrame:
    """(x - mean) / deviation; a constant column becomes 0."""
    return df.withColumns({
        c: (F.col(c) - F.lit(mean)) / F.lit(dev if dev else 1.0)
        for c, (mean, dev) in scale.items()})


# -- fits --------------------------------------------------------------------------

@dataclass
class Fitted:
    """A fitted model with everything needed to score raw rows."""

    features: list
    classes: list
    medians: dict
    scale: dict = field(default_factory=dict)
    models: list = field(default_factory=list)   # one over all classes, or one for each of them

    @property
    def trees(self) -> int | None:
        counts = [m.getNumTrees for m in self.models if hasattr(m, "getNumTrees")]
        return max(1, round(sum(counts) / len(counts))) if counts else None

    def probabilities(self, df: DataFrame, output: str) -> DataFrame:
        """Add ``output``, a map from class name to probability; other columns stay."""
        kept = df.select(F.struct(*df.columns).alias("_row"), *[
            F.col(c) for c in self.features])
        rows = assemble(standardise(fill_medians(kept, self.medians), self.scale), self.features)
        rows, chances = class_chances(rows, self.models, self.features, len(self.classes))
        pairs = [x for c, p in zip(self.classes, chances) for x in (F.lit(str(c)), p)]
        return rows.select("_row.*", F.create_map(*pairs).alias(output))


def class_chances(rows: DataFrame, models: list, features, classes: int) -> tuple:
    """(rows, one column per class) from the ``features`` vector or, if boosted, its parts.

    No model stands for a single class, which gets all the probability; several models are one
    class against the rest each and are normalised. A class the model has not seen gets 0.
    """
    if not models:
        return rows, [F.lit(1.0)]
    if isinstance(models[0], Forest):
        cells = materialise(rows.withColumn("_bins", binned(features, models[0].cuts)))
        chances = models[0].chances(cells.select(F.col("_bins").alias("bins"))).select(
            F.col("bins").alias("_bins"), *[F.col(f"s{i}").alias(f"_p{i}") for i in range(classes)])
        return spread_join(cells, chances, ["_bins"], "left"), [F.col(f"_p{i}") for i in range(classes)]
    if isinstance(models[0], Boosted):
        model = models[0]
        importable(rows.sparkSession)

        @F.arrow_udf("array<double>")
        def score(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            chances = model.remembering()
            for columns in batches:
                found = chances([c.to_numpy(zero_copy_only=False) for c in columns])
                ends = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))

        rows = rows.withColumn("_p", score(*[F.col(c).cast("double") for c in features]))
        return rows, [F.get("_p", F.lit(i)) for i in range(classes)]
    if len(models) == 1:
        rows = models[0].transform(rows).withColumn("_p", vector_to_array("probability"))
        return rows, [F.coalesce(F.get("_p", F.lit(i)), F.lit(0.0)) for i in range(classes)]
    for i, model in enumerate(models):
        model = model.copy()
        model.setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}")
        model.setPredictionCol(f"_y{i}")
        rows = model.transform(rows)
    parts = [vector_to_array(f"_p{i}")[1] for i in range(len(models))]
    whole = reduce(lambda a, b: a + b, parts)
    return rows, [p / F.nullif(whole, F.lit(0.0)) for p in parts]


def chance(output: str, name) -> Column:
    """Probability of one class; 0 for a class the model has never seen."""
    return F.coalesce(F.col(output)[F.lit(str(name))], F.lit(0.0))


def score(df: DataFrame, model: Fitted, prefix: str = "p_") -> DataFrame:
    """Class probabilities as columns."""
    return model.probabilities(df, "_chances").withColumns({
        f"{prefix}{c}": chance("_chances", c) for c in model.classes}).drop("_chances")


def class_names(df: DataFrame, label: str) -> list:
    """The distinct labels in order; an error if there are too many to be classes."""
    found = [r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().limit(
        MOST_CLASSES + 1).collect()]
    if not found:
        raise ValueError("no rows to fit on")
    if len(found) > MOST_CLASSES:
        raise ValueError(f"{label} has more than {MOST_CLASSES} values")
    return sorted(found)


def _index(label: str, classes: list) -> Column:
    found = F.lit(None)
    for i, c in enumerate(classes):
        found = F.when(F.col(label) == F.lit(c), i).otherwise(found)
    return found.cast("int")


def _training(df, features, label, weighted, scaled):
    """(rows with features, label index and weight, Fitted without a model, rows)."""
    df = df.where(F.col(label).isNotNull())
    classes = class_names(df, label)
    values = medians(df, features)
    filled = fill_medians(df, values)
    scale = scaling(filled, features) if scaled else {}
    sizes = {r[label]: r["class_rows"] for r in class_sizes(filled, label).collect()}
    n, k = sum(sizes.values()), len(sizes)
    weight = F.lit(1.0)
    for c in classes:
        if weighted == "balanced":
            weight = F.when(F.col(label) == F.lit(c), n / (k * sizes[c])).otherwise(weight)
    if weighted == "positive" and k == 2:
        weight = F.when(F.col(label) == F.lit(classes[1]),
                        sizes[classes[0]] / sizes[classes[1]]).otherwise(F.lit(1.0))
    rows = assemble(standardise(filled, scale), features).withColumns(
        {"_label": _index(label, classes).cast("double"), "_weight": weight})
    return rows, Fitted(list(features), classes, values, scale), n


def linear_models(rows: DataFrame, classes: int, n: int, l1: bool, each_class: bool,
                  iterations: int, c: float = 1.0) -> list:
    """Logistic fits on ``features``, ``_label``, ``_weight``: one, or one per class.

    The penalty is 1 / (c * n), as the loss is the weighted mean over the n rows.
    """
    many = classes > 2
    estimator = LogisticRegression(
        labelCol="_label", weightCol="_weight", maxIter=iterations, regParam=1.0 / (c * n),
        elasticNetParam=1.0 if l1 else 0.0, standardization=False,
        family="multinomial" if many and not each_class else "binomial")
    if many and each_class:
        return [estimator.fit(rows.withColumn("_label", (F.col("_label") == i).cast("double")))
                for i in range(classes)]
    return [estimator.fit(rows)]


def forest_models(rows: DataFrame, trees: int, depth: int, seed: int) -> list:
    """A forest on ``features``, ``_label``, ``_weight``.

    Every pass splits as many nodes as fit into ``FOREST_MB``; which node a row is in is kept
    between passes, or each pass would run every row through all trees again.
    """
    return [RandomForestClassifier(
        labelCol="_label", weightCol="_weight", numTrees=trees, maxDepth=depth, seed=seed,
        maxMemoryInMB=FOREST_MB, cacheNodeIds=True).fit(rows)]


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` training rows of a forest over the cores there are.

    They take so few bytes that Spark reads them in one task, which every pass would wait for.
    No more tasks than cores: each sends the statistics of all nodes.
    """
    tasks = min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // FOREST_ROWS))
    return rows.repartition(tasks) if tasks > 1 else rows


def fit_logit(df: DataFrame, features, label: str, l1: bool = False,
              weighted: str | None = "balanced", each_class: bool = False,
              iterations: int = 100, c: float = 1.0) -> Fitted:
    """Logistic regression on standardised features, L1 or L2.

    More than two classes: one multinomial fit, or with ``each_class`` one against the rest.
    """
    rows, fitted, n = _training(df, features, label, weighted, scaled=True)
    if len(fitted.classes) > 1:
        fitted.models = linear_models(rows, len(fitted.classes), n, l1, each_class, iterations, c)
    return fitted


def fit_forest(df: DataFrame, features, label: str, trees: int = TREES,
               depth: int = FOREST_DEPTH, seed: int = 0) -> Fitted:
    """Random forest with balanced classes."""
    rows, fitted, n = _training(df, features, label, "balanced", scaled=False)
    if len(fitted.classes) == 1:
        return fitted
    if n > FOREST_MOST:
        cells = Cells.of(rows.select(
            F.lit(0).alias("fold"), F.lit(False).alias("val"), F.col("_label").alias("label"),
            F.col("_weight").alias("weight"), *features), features, len(fitted.classes))
        if cells.most <= FOREST_CELLS:
            fitted.models = [stored_forest(cells, trees, depth, seed)]
            return fitted
    fitted.models = forest_models(dealt(rows, n), trees, depth, seed)
    return fitted


def fit_boost(df: DataFrame, features, label: str, trees: int = TREES, depth: int = 5,
              step: float = 0.1, validation: str | None = None, patience: int = PATIENCE,
              **settings) -> Fitted:
    """Gradient boosted trees, all classes in one run.

    ``validation`` names a boolean column: its rows are not trained on, and boosting stops when
    their score has not improved for ``patience`` rounds. Without it ``trees`` rounds are grown.
    Two classes weigh the positive one up, more are balanced.
    """
    held = F.lit(False) if validation is None else F.coalesce(F.col(validation), F.lit(False))
    train = df.where(~held)
    two = len(class_names(train, label)) == 2
    rows, fitted, _ = _training(train, features, label, "positive" if two else "balanced", False)
    if len(fitted.classes) == 1:
        return fitted
    table = rows.select(F.lit(0).alias("fold"), F.lit(False).alias("val"),
                        F.col("_label").alias("label"), F.col("_weight").alias("weight"), *features)
    if validation is not None:
        checks = fill_medians(df.where(held), fitted.medians).withColumn(
            "label", _index(label, fitted.classes)).where("label IS NOT NULL")
        table = table.unionByName(checks.select(
            F.lit(0).alias("fold"), F.lit(True).alias("val"), F.col("label").cast("double"),
            F.lit(1.0).alias("weight"), *features))
    table = materialise(table)
    fitted.models = [boost(table, features, len(fitted.classes), trees, depth, step,
                           patience=None if validation is None else patience, **settings)[0]]
    return fitted


# -- comparison ----------------------------------------------------------------------

@dataclass
class Design:
    """One stored table for all fits of a cross-validation.

    ``rows`` holds every row once per fold: id (struct), label, fold, val (is it that fold's
    validation row), index of the class, balanced and positive weights, and the features with
    the medians of that fold's training rows put in. Files are apart by fold.
    """

    rows: DataFrame
    features: list
    classes: list
    scale: dict      # fold -> feature -> (mean, deviation) of the training rows
    sizes: dict      # fold -> training rows

    def part(self, fold: int, scaled: bool, weighted: str | None) -> DataFrame:
        """One fold's rows with ``features`` vector, ``_label`` and ``_weight``."""
        rows = self.rows.where(F.col("fold") == fold)
        if scaled:
            rows = standardise(rows, self.scale[fold])
        return assemble(rows, self.features).withColumns({
            "_label": F.col("index").cast("double"),
            "_weight": F.col(weighted) if weighted else F.lit(1.0)})


def design(df: DataFrame, features, label: str, key: Column, ties, folds: int = FOLDS,
           seed: int = 0, keep=()) -> Design:
    """Stratified folds, medians, weights and scales of every fold, in a few jobs for all folds.

    ``keep`` names the columns that go into ``id``. Rows without a label are left out.
    """
    spark, features = df.sparkSession, list(features)
    classes = class_names(df, label)
    folded = materialise(stratified_folds(
        df.where(F.col(label).isNotNull()), label, folds, key, ties, seed).select(
        F.struct(*[F.col(c) for c in keep] or [F.lit(0).alias("none")]).alias("id"),
        F.col(label).alias("label"), F.col("fold").alias("_own"),
        *[F.col(c).cast("double").alias(c) for c in features]))
    each = folded.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn(
        "val", F.col("fold") == F.col("_own"))
    train = each.where("not val")
    # all of this is one number per fold and feature or class
    middle: dict = {c: {} for c in features}
    for r in quantile_table(train, features, [0.5], ["fold"]).collect():
        middle[r["feature"]][r["fold"]] = r["value"]
    sizes: dict = {f: {} for f in range(folds)}
    for r in train.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["fold"]][r["label"]] = r["n"]

    def by_fold(values: dict) -> Column:
        found = F.lit(None).cast("double")
        for f, v in values.items():
            found = F.when(F.col("fold") == f, F.lit(float(v))).otherwise(found)
        return found

    balanced, positive = F.lit(1.0), F.lit(1.0)
    for c in classes:
        balanced = F.when(F.col("label") == F.lit(c), by_fold({
            f: sum(n.values()) / (len(n) * n[c]) for f, n in sizes.items() if n.get(c)})
        ).otherwise(balanced)
    if len(classes) == 2:
        no, yes = classes
        positive = F.when(F.col("label") == F.lit(yes), by_fold({
            f: n.get(no, 0) / n[yes] for f, n in sizes.items() if n.get(yes)})).otherwise(positive)
    path = scratch_path(spark, "design")
    each.select(
        "id", "label", "fold", "val", _index("label", classes).alias("index"),
        F.coalesce(balanced, F.lit(1.0)).alias("balanced"),
        F.coalesce(positive, F.lit(1.0)).alias("positive"),
        *[F.coalesce(F.col(c), by_fold(middle[c]), F.lit(0.0)).alias(c) for c in features]
    ).write.partitionBy("fold").parquet(path)
    rows = spark.read.parquet(path)
    scale: dict = {f: {} for f in range(folds)}
    for r in rows.where("not val").groupBy("fold").agg(*[
            g(c).alias(f"{n}{i}") for i, c in enumerate(features)
            for n, g in (("m", F.avg), ("s", F.stddev_pop))]).collect():
        scale[r["fold"]] = {c: (r[f"m{i}"], r[f"s{i}"]) for i, c in enumerate(features)}
    return Design(rows, features, classes, scale,
                  {f: sum(n.values()) for f, n in sizes.items()})


def algorithms(trees: int = TREES, weighted: str | None = "balanced", plain: bool = False,
               iterations: int = 100, patience: int = PATIENCE, depth: int = FOREST_DEPTH) -> dict:
    """Name to (kind, settings) of the fits that are compared."""
    found = {
        "boost": ("boost", dict(rounds=trees, patience=patience)),
        "forest": ("forest", dict(trees=trees, depth=depth)),
        "lasso": ("linear", dict(l1=True, each_class=True, weighted=weighted, iterations=iterations)),
        "ridge": ("linear", dict(l1=False, each_class=False, weighted=weighted,
                                 iterations=iterations)),
    }
    if plain:
        found["logit"] = ("linear", dict(l1=False, each_class=True, weighted=weighted,
                                         iterations=iterations))
    return found


def boost_folds(of: Design, rounds: int = TREES, patience: int = PATIENCE, **settings) -> dict:
    """fold -> boosted model, all folds grown in the same passes."""
    weight = "positive" if len(of.classes) == 2 else "balanced"
    rows = of.rows.select("fold", "val", F.col("index").alias("label"),
                          F.col(weight).alias("weight"), *of.features)
    return boost(rows, of.features, len(of.classes), rounds, patience=patience, **settings)


def side_by_side(spark: SparkSession, jobs: dict) -> dict:
    """Name to result of independent functions that run Spark jobs, ``SIDE_BY_SIDE`` at a time."""
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        waiting = {name: pool.submit(inheritable_thread_target(spark)(job))
                   for name, job in jobs.items()}
        return {name: one.result() for name, one in waiting.items()}


def _boosted(of: Design, settings: dict) -> tuple:
    """(stored scores of the validation rows, fold -> trees) of one boosting run."""
    models = boost_folds(of, **settings)
    return materialise(_boosted_scores(of, models)), {
        f: m.getNumTrees for f, m in models.items()}


def _boosted_scores(of: Design, models: dict) -> DataFrame:
    """fold, id, label and scores of the validation rows, in one pass for all folds."""
    names = [f"s{i}" for i in range(len(of.classes))]
    features = of.features

    def scored(batches):
        chances = {f: m.remembering() for f, m in models.items()}
        for batch in batches:
            at = {n: k for k, n in enumerate(batch.schema.names)}
            fold = batch.column(at["fold"]).to_numpy()
            values = [batch.column(at[f"_x{i}"]).to_numpy() for i in range(len(features))]
            found = np.zeros((len(fold), len(names)))
            for f in np.unique(fold):
                own = fold == f
                found[own] = chances[f]([v[own] for v in values])
            yield pa.RecordBatch.from_arrays(
                [batch.column(at[c]) for c in ("fold", "id", "label")]
                + [pa.array(found[:, k]) for k in range(len(names))],
                names=["fold", "id", "label", *names])

    rows = of.rows.where("val").select("fold", "id", "label", *[
        F.col(c).alias(f"_x{i}") for i, c in enumerate(features)])
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(scored, ", ".join(
        [f"{c} {kinds[c]}" for c in ("fold", "id", "label")] + [f"{n} double" for n in names]))


def _forest(of: Design, cells: Cells, settings: dict) -> tuple:
    """(stored scores of the validation rows, fold -> trees) of the forests of all folds."""
    chances = fold_chances(cells, **settings)
    rows = of.rows.where("val").select(
        "fold", "id", "label", binned(of.features, cells.cuts).alias("bins"))
    return materialise(spread_join(rows, chances, ["fold", "bins"], "left").drop("bins")), {
        f: settings["trees"] for f in of.sizes}


def _forest_cells(of: Design) -> Cells | None:
    """The counted rows, if there are too many rows for Spark's forests and not too many cells."""
    if len(of.classes) == 1 or max(of.sizes.values()) <= FOREST_MOST:
        return None
    cells = Cells.of(of.rows.select(
        "fold", "val", F.col("index").alias("label"), F.col("balanced").alias("weight"), *of.features),
        of.features, len(of.classes))
    return cells if cells.most <= FOREST_CELLS else None


def _native_scores(of: Design, fold: int, kind: str, settings: dict) -> tuple:
    """(stored scores of one fold's validation rows, trees) of one fit."""
    settings = dict(settings)
    if kind == "linear":
        part = of.part(fold, True, settings.pop("weighted"))
        models = linear_models(part.where("not val"), len(of.classes), of.sizes[fold], **settings)
    else:
        part = of.part(fold, False, "balanced")
        train = dealt(part.where("not val"), of.sizes[fold])
        models = forest_models(train, seed=fold, **settings)
    rows, chances = class_chances(part.where("val"), models, of.features, len(of.classes))
    trees = models[0].getNumTrees if hasattr(models[0], "getNumTrees") else None
    return materialise(rows.select("fold", "id", "label", *[
        c.alias(f"s{i}") for i, c in enumerate(chances)])), trees


def cross_scores(of: Design, fits: dict | None = None, repeat: int = 0) -> tuple:
    """(scores, sizes): validation scores (algorithm, repeat, fold, id, label, s0, s1, ...) of
    every fit on every fold, stored, and (algorithm, repeat, fold, trees) as a list.

    Boosting and forests of many rows run once for all folds. The fits do not depend on each other and are submitted
    side by side; each one is distributed.
    """
    fits = algorithms() if fits is None else fits
    folds = sorted(of.sizes)
    cells = _forest_cells(of) if any(kind == "forest" for kind, _ in fits.values()) else None
    jobs = {}
    for name, (kind, settings) in fits.items():   # these first, they take longest
        if kind == "boost":
            jobs[name, None] = lambda settings=settings: _boosted(of, settings)
        elif kind == "forest" and cells is not None:
            jobs[name, None] = lambda settings=settings: _forest(of, cells, settings)
    for name, (kind, settings) in fits.items():
        if (name, None) not in jobs:
            for f in folds:
                jobs[name, f] = lambda f=f, at=(kind, settings): _native_scores(of, f, *at)
    found = side_by_side(of.rows.sparkSession, jobs)
    sizes, tables = [], []
    for (name, fold), (rows, trees) in found.items():
        tables.append(rows.select(F.lit(name).alias("algorithm"), F.lit(repeat).alias("repeat"), "*"))
        for f in folds if fold is None else [fold]:
            sizes.append((name, repeat, f, trees[f] if fold is None else trees))
    return materialise(reduce(DataFrame.unionByName, tables)), sizes


def compare_models(df: DataFrame, features, label: str, key: Column, ties, folds: int = FOLDS,
                   repeats: int = 1, fits: dict | None = None) -> DataFrame:
    """(algorithm, repeat, fold, auc, trees) of every fit on every fold.

    One stored design and one AUC job over all validation scores serve all fits.
    """
    scores, sizes, classes = None, [], None
    for repeat in range(repeats):
        of = design(df, features, label, key, ties, folds, seed=repeat)
        classes = of.classes
        rows, trees = cross_scores(of, fits, repeat)
        scores = rows if scores is None else scores.unionByName(rows)
        sizes += trees
    return fold_aucs(scores, classes, sizes)


def fold_aucs(scores: DataFrame, classes: list, sizes: list) -> DataFrame:
    """(algorithm, repeat, fold, auc, trees) from stored scores and sizes."""
    by = ["algorithm", "repeat", "fold"]
    if len(classes) == 2:
        hits = scores.withColumn("hit", (F.col("label") == F.lit(classes[1])).cast("int"))
        aucs = roc_auc(hits, "hit", "s1", by)
    else:
        aucs = roc_auc_ovr(scores, "label", {c: f"s{i}" for i, c in enumerate(classes)}, by)
    trees = scores.sparkSession.createDataFrame(
        sizes, "algorithm string, repeat int, fold int, trees int")
    return aucs.join(F.broadcast(trees), by)


def best_rounds(of: Design, rounds: int = TREES, patience: int = PATIENCE) -> int:
    """Median over the folds of the rounds after which boosting was best, 1 at least."""
    found = [m.getNumTrees for m in boost_folds(of, rounds, patience).values()]
    return max(1, int(np.round(np.median(found))))


def cv_report(scores: DataFrame, by: str = "algorithm", trees: str | None = None) -> DataFrame:
    """Median and population deviation of fold scores, median number of trees.

    A group has one row per fold and repeat.
    """
    stops = [F.median(trees).alias("median_trees")] if trees else []
    return scores.groupBy(by).agg(
        F.median("auc").alias("median_auc"), F.stddev_pop("auc").alias("std_auc"), *stops)


def importance(spark: SparkSession, model: Fitted) -> DataFrame:
    """(feature, importance in percent), largest first.

    Linear models: mean absolute coefficient over the classes, as share of the sum.
    Forests: Spark's importances. Boosting: the share of the gain.
    """
    tables = []
    for m in model.models:
        if isinstance(m, (Boosted, Forest)):
            tables.append((m.gain / (m.gain.sum() or 1.0)).tolist())
        elif hasattr(m, "coefficientMatrix"):
            tables += [list(map(abs, row)) for row in m.coefficientMatrix.toArray().tolist()]
        else:
            tables.append(m.featureImportances.toArray().tolist())
    means = [sum(t[i] for t in tables) / len(tables) if tables else 0.0
             for i in range(len(model.features))]
    whole = sum(means) or 1.0
    rows = [(f, 100.0 * v / whole) for f, v in zip(model.features, means)]
    return spark.createDataFrame(rows, "feature string, importance double").withColumn(
        "feature", title_label(F.col("feature"))).orderBy(F.desc("importance"), "feature")
