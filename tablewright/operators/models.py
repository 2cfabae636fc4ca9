"""Model candidates on Spark ML, their cross-validation, and the feature-blind baseline.

The families follow the tabular line-up: boosted trees grown level by level, boosted trees grown best leaf
first, boosted trees on coded categories, a kernel machine over landmarks, nearest neighbours, and a linear
model; a random forest can be asked for besides.
"""

from __future__ import annotations

import json
import math
import threading
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import (
    LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel, RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.functions.hashing import default_key, digest
from tablewright.functions.kinds import columns_of, q
from tablewright.operators import boosting, kernel, neighbours
from tablewright.operators import metrics as M
from tablewright.operators.features import Encoder
from tablewright.operators.ordered import TargetCodes, ordered_codes
from tablewright.operators.sampling import SEED, class_table, early_stopping_slice, uniform_sample, with_class_weights
from tablewright.session import ROWS_PER_TASK, dropped, written

# Default settings.
DEFAULTS: dict[str, dict[str, object]] = {
    "boosted": {"learning_rate": 0.05, "max_depth": 6, "subsample": 0.9, "column_share": 0.9},
    "leafwise": {"learning_rate": 0.05, "max_leaves": 31, "subsample": 0.9, "column_share": 0.9},
    "forest": {"max_depth": 8, "subsample": 0.9, "column_share": 0.9},
    "boosted_codes": {"learning_rate": 0.05, "max_depth": 6},
    "kernel": {"C": 1.0, "gamma": "scale"},
    "neighbours": {"n_neighbors": 15, "weights": "distance"},
    "linear": {"strength": 1.0},
}
STYLE = {"boosted": "tree", "leafwise": "tree", "forest": "tree", "boosted_codes": "ordinal",
         "kernel": "scaled", "neighbours": "scaled", "linear": "scaled"}
GROUPS = (("boosted", "leafwise", "boosted_codes"), ("kernel", "neighbours", "linear"))
BOOSTED = ("boosted", "leafwise", "boosted_codes")
MAX_TREES = 3_000
PREPARED_AT_ONCE = 4  # training tables that are encoded side by side
LEAF_CURVATURE = 1.0  # least sum of second derivatives in a leaf
LEAF_PENALTY = {"boosted": 1.0, "leafwise": 1.0, "boosted_codes": 3.0}
FOREST_TREES = 100
FOREST_TASK_ROWS = 100_000  # some 50 MB with the draws of the trees
FOREST_BINS = 64
FOREST_PARTS = 16  # that the rows of equal bins are drawn in
BASELINE_MARGIN = 0.01


# -- regularisation on the scale of the textbook formulas ---------------------------------


def logistic_penalty(strength: float, weight_sum: float) -> float:
    """Spark averages the loss over the weights, so C becomes 1 / (C * sum of weights)."""
    return 1.0 / (strength * weight_sum)


def ridge_penalty(alpha: float, rows: int, target_std: float) -> float:
    """Spark divides the loss by the rows and works on a target scaled by its deviation."""
    return alpha * target_std / rows


def scale_gamma(df: DataFrame, width: int, features: str = "features") -> float:
    """1 / (width * variance of all entries), from one summary of the feature vectors."""
    row = df.select(Summarizer.metrics("mean", "variance").summary(q(features)).alias("s")).select("s.*").first()
    mean, variance = np.array(row["mean"]), np.array(row["variance"])
    spread = float((variance + mean ** 2).mean() - mean.mean() ** 2)
    return 1.0 / (width * spread) if spread > 0 else 1.0


# -- fitting ---------------------------------------------------------------------------------


@dataclass
class Fitted:
    """A trained candidate: its encoder, its Spark ML model, and what scoring needs to know."""

    name: str
    task: str
    params: dict[str, object]
    encoder: Encoder
    labels: list[str]
    model: Model | None = None
    kernel: kernel.KernelModel | None = None
    target_scale: tuple[float, float] = (0.0, 1.0)
    trees: int | None = None
    ensembles: list[boosting.Ensemble] = field(default_factory=list)
    codes: TargetCodes | None = None
    borders: list[list[float]] = field(default_factory=list)  # a forest's, between the bins of each feature
    neighbour_rows: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` (a class number or a value) and, when known, ``probability``."""
        kept = df.columns
        coded = df if self.codes is None else self.codes.transform(df)
        if self.ensembles:
            return self._boosted(self.encoder.numbers(coded, "__x"), kept)
        encoded = self.encoder.transform(coded)
        if self.name == "neighbours":
            return self._vote(encoded, kept)
        if self.kernel is not None:
            return self._kernel(encoded, kept)
        scored = self.model.transform(in_bins(encoded, self.borders) if self.borders else encoded)
        out = [q(c) for c in kept] + [q("prediction").cast("double").alias("prediction")]
        if "probability" in scored.columns:
            out.append(vector_to_array(q("probability")).alias("probability"))
        return scored.select(*out)

    def _kernel(self, encoded: DataFrame, kept: Sequence[str]) -> DataFrame:
        found = kernel.margins(vector_to_array("features"), self.kernel, encoded.sparkSession)
        scored = encoded.select(*[q(c) for c in kept], found.alias("__margins"))
        first, (middle, spread) = F.col("__margins")[0], self.target_scale
        if self.task != "classification":
            prediction = first * spread + middle
        elif len(self.labels) > 2:
            prediction = (F.array_position("__margins", F.array_max("__margins")) - 1).cast("double")
        else:
            prediction = (first > 0).cast("double")
        return scored.select(*[q(c) for c in kept], prediction.alias("prediction"))

    def _boosted(self, encoded: DataFrame, kept: Sequence[str]) -> DataFrame:
        """Two classes have one model, more have one each, whose chances are brought to a sum of one."""
        raw = boosting.raw_scores(F.col("__x"), self.ensembles, encoded.sparkSession)
        scored = encoded.select(*[q(c) for c in kept], raw.alias("__raw"))
        out = [q(c) for c in kept]
        if self.task != "classification":
            return scored.select(*out, F.col("__raw")[0].alias("prediction"))
        chance = F.transform("__raw", lambda r: 1 / (1 + F.exp(-r)))
        if len(self.ensembles) == 1:
            likely = F.array(1 - chance[0], chance[0])
        else:
            total = F.aggregate(chance, F.lit(0.0), lambda a, c: a + c)
            likely = F.transform(chance, lambda c: c / total)
        scored = scored.select(*out, likely.alias("probability"))
        best = F.array_position("probability", F.array_max("probability")) - 1
        return scored.select(*out, best.cast("double").alias("prediction"), "probability")

    def _vote(self, encoded: DataFrame, kept: Sequence[str]) -> DataFrame:
        keyed = encoded.withColumn("__key", digest(encoded.select(*[q(c) for c in kept]), kept)).withColumn("v", vector_to_array(q("features")))
        near = neighbours.nearest(
            keyed.select(F.col("__key").alias("key"), "v").dropDuplicates(["key"]), self.neighbour_rows, "key", "v", "y",
            int(self.params["n_neighbors"]), copies="copies")
        how = str(self.params["weights"])
        found = neighbours.vote(near, how) if self.task == "classification" else neighbours.average(near, how)
        found = found.select(F.col("key").alias("__found"), F.col("prediction").cast("double").alias("prediction"))
        return keyed.join(found, keyed["__key"] == found["__found"]).select(*[q(c) for c in kept], "prediction")


def label_index(labels: Sequence[str], target: Column) -> Column:
    """The class number of a target, as a literal lookup of the (few) classes."""
    spot = F.array_position(F.array(*[F.lit(x) for x in labels]), target.cast("string"))
    return F.when(spot > 0, (spot - 1).cast("double"))


def fit(name: str, task: str, params: Mapping[str, object], train: DataFrame, target: str, features: Sequence[str],
        labels: Sequence[str] = (), balanced: bool = False, key: Sequence[str] | None = None,
        trees: int | None = None, max_trees: int = MAX_TREES, neighbour_rows: int = neighbours.MAX_TRAIN_ROWS) -> Fitted:
    """Fit one candidate on ``train``. Encoders see these rows only, so no fold leaks into another.

    Boosted trees with ``trees=None`` hold a tenth back, take the tree count with the least loss there
    and are fitted again with it on all rows. Neighbours vote among at most ``neighbour_rows`` labelled
    rows, drawn by hash; the bound is part of the result (``extra``).
    """
    if name in BOOSTED:
        if trees is None:
            trees = fit_boosted(name, task, params, [train], target, features, labels, balanced, key, max_trees)[0].trees
        return fit_boosted(name, task, params, [train], target, features, labels, balanced, key, trees, stop_early=False)[0]
    made = prepare(name, task, train, target, features, labels, balanced, key, neighbour_rows)
    fitted = fit_prepared(made, params, trees, max_trees)
    made.close()  # no model reads its written rows again
    return fitted


@dataclass
class Prepared:
    """A training table as a family sees it: all that no setting of the family changes, so that many fits can share it."""

    name: str
    task: str
    encoder: Encoder
    labels: list[str]
    data: DataFrame
    rows: int
    weight: float | None = None
    held: DataFrame | None = None
    borders: list[list[float]] = field(default_factory=list)
    tables: list[DataFrame] = field(default_factory=list)  # written ones

    def close(self) -> None:
        for table in self.tables:
            dropped(table)


def prepare(name: str, task: str, train: DataFrame, target: str, features: Sequence[str], labels: Sequence[str] = (), balanced: bool = False,
            key: Sequence[str] | None = None, neighbour_rows: int = neighbours.MAX_TRAIN_ROWS, shared: bool = False) -> Prepared:
    """The encoder of a training table, and its rows encoded: for a linear classifier equal ones as one, for a forest those of
    equal bins as 16 at most. ``shared`` by many fits, they are written."""
    rows = train.count()
    if name == "neighbours" and rows > neighbour_rows:
        train, rows = uniform_sample(train, neighbour_rows, default_key(train, key)), neighbour_rows
    encoder = Encoder.fit(train, features, STYLE[name], rows)
    labels = [str(x) for x in labels]
    weighted = _weighted(train, task, target, labels, balanced)
    part = F.pmod(F.xxhash64(*[q(c) for c in default_key(train, key)]), F.lit(FOREST_PARTS)) if name == "forest" else F.lit(0)
    data = encoder.transform(weighted.withColumn("__part", part)).select("features", "__y", "__weight", "__part")
    made = Prepared(name, task, encoder, labels, data.drop("__part"), rows)
    if name == "forest":
        made.borders = bin_borders(data, encoder)
        made.data = written(_equal_rows(in_bins(data, made.borders), "__part"), "forest-cells")
        made.rows = made.data.count()
        made.tables.append(made.data)
        return made
    data = made.data
    if name == "linear" and task == "classification":
        made.data = written(_equal_rows(data), "linear-rows")  # one fit reads them several times
        made.weight = made.data.agg(F.sum("__weight")).first()[0]
        made.tables.append(made.data)
    elif shared:
        made.data = written(data, "linear-rows")
        made.tables.append(made.data)
    return made


def fit_prepared(made: Prepared, params: Mapping[str, object], trees: int | None = None, max_trees: int = MAX_TREES) -> Fitted:
    """One fit on rows that were prepared for its family."""
    name, data, classification = made.name, made.data, made.task == "classification"
    fitted = Fitted(name, made.task, dict(params), made.encoder, made.labels)
    if name == "neighbours":
        # Equal rows become one with a count, so that many copies do not end up in one block.
        rows_ = data.select(vector_to_array("features").alias("v"), F.col("__y").alias("y")).groupBy("v", "y").agg(
            F.count(F.lit(1)).alias("copies"))
        fitted.extra["neighbour_rows"] = made.rows
        fitted.neighbour_rows = rows_.select(F.md5(F.to_json(F.struct("v", "y"))).alias("key"), "v", "y", "copies")
        return fitted
    if name == "linear":
        fitted.model = _fit_linear(fitted, made)
        return fitted
    if name == "kernel":
        fitted.kernel = _fit_kernel(fitted, data.where(F.col("__y").isNotNull()), len(made.encoder.names()))
        return fitted
    settings = {"featuresCol": "features", "labelCol": "__y", "seed": SEED, "maxBins": FOREST_BINS + 1,
                "maxDepth": int(params["max_depth"]), "subsamplingRate": float(params.get("subsample", 1.0)),
                "featureSubsetStrategy": str(params.get("column_share", "all"))}
    settings["weightCol"] = "__weight"
    maker = RandomForestClassifier if classification else RandomForestRegressor
    fitted.borders = made.borders
    fitted.model = maker(**settings, numTrees=trees or min(FOREST_TREES, max_trees)).fit(_dealt(data, made.rows))
    return fitted


def _dealt(data: DataFrame, rows: int) -> DataFrame:
    """Rows for a forest, in tasks of bounded size: each row is held with its draws of all trees, and every level reads them again."""
    cores = data.sparkSession.sparkContext.defaultParallelism
    return data.repartition(max(min(cores, rows // ROWS_PER_TASK + 1), math.ceil(rows / FOREST_TASK_ROWS)))


def bin_borders(data: DataFrame, encoder: Encoder) -> list[list[float]]:
    """Where the bins of each encoded feature begin, but for its first."""
    levels = {f"{c}_{x}" for c, found in encoder.levels.items() for x in found}  # 0 or 1
    names, x = encoder.names(), vector_to_array("features")
    sought = [i for i, name in enumerate(names) if i < len(encoder.numeric) or name not in levels]
    out = [[0.5] for _ in names]
    if sought:
        edges = boosting.bin_edges(data.select(F.lit(0).alias("model"), F.array(*[x[i] for i in sought]).alias("x")), len(sought), FOREST_BINS)
        for i, ends in zip(sought, edges.get(0, [[]] * len(sought))):
            after = np.nextafter(np.array(ends, float), np.inf)  # a value that equals an edge is below it
            out[i] = np.unique(after[np.isfinite(after)]).tolist()
    return out


def in_bins(df: DataFrame, borders: Sequence[Sequence[float]]) -> DataFrame:
    """``df`` with each of its ``features`` as the number of its bin."""
    kept, x = df.columns, vector_to_array("features")
    raw, binned = [f"__x{i}" for i in range(len(borders))], [f"__b{i}" for i in range(len(borders))]
    ends = [[-math.inf, *(b or [0.0]), math.inf] for b in borders]  # a constant has no borders, but is in one bin with any
    wide = df.withColumns({name: x[i] for i, name in enumerate(raw)}).drop("features")
    wide = Bucketizer(splitsArray=ends, inputCols=raw, outputCols=binned, handleInvalid="keep").transform(wide)
    return VectorAssembler(inputCols=binned, outputCol="features").transform(wide).select(*[q(c) for c in kept])


class FoldScores:
    """Fold scores of one family under many settings, as a search asks for them.

    The encoder of a fold and its encoded rows are the same under all settings: those of all folds are made side by side when a
    score is first asked for, written, and read by every fit, also by those that run at the same time.
    """

    def __init__(self, name: str, task: str, data: DataFrame, target: str, features: Sequence[str], folds: int, metric: str,
                 labels: Sequence[str] = (), balanced: bool = False, key: Sequence[str] | None = None, **how):
        self.name, self.task, self.data, self.target, self.features, self.folds, self.metric = name, task, data, target, features, folds, metric
        self.labels, self.balanced, self.key, self.how = labels, balanced, key, how
        self.made: list[Prepared] = []
        self.lock = threading.Lock()

    def __enter__(self) -> FoldScores:
        return self

    def __exit__(self, *_) -> None:
        for made in self.made:
            made.close()

    def _prepared(self, fold: int) -> Prepared:
        train, held = self.data.filter(F.col("fold") != fold), self.data.filter(F.col("fold") == fold)
        made = prepare(self.name, self.task, train, self.target, self.features, self.labels, self.balanced, self.key, shared=True)
        encoded = made.encoder.transform(_labelled(made, held, self.target, self.features))
        made.held = written(encoded.select("features", "label"), "held-rows")
        made.tables.append(made.held)
        return made

    def _fold(self, fold: int) -> Prepared:
        with self.lock:
            if not self.made:
                with ThreadPoolExecutor(PREPARED_AT_ONCE) as pool:
                    self.made = list(pool.map(self._prepared, range(self.folds)))
        return self.made[fold]

    def __call__(self, params: Mapping[str, object], fold: int) -> float:
        if self.name != "linear":
            return fold_score(self.name, self.task, params, self.data, self.target, self.features, fold, self.metric, self.labels,
                              self.balanced, self.key, **self.how)
        made = self._fold(fold)
        return score(self.metric, fit_prepared(made, params).model.transform(made.held))


def _weighted(train: DataFrame, task: str, target: str, labels: Sequence[str], balanced: bool) -> DataFrame:
    """``train`` with its target as a number, ``__y``, and ``__weight``."""
    classification = task == "classification"
    y = label_index(labels, q(target)) if classification else q(target).cast("double")
    weighted = with_class_weights(train, target, "__weight") if classification and balanced else train.withColumn("__weight", F.lit(1.0))
    return weighted.withColumn("__y", y)


def boosting_settings(name: str, task: str, params: Mapping[str, object]) -> boosting.Settings:
    leaves = params.get("max_leaves")
    return boosting.Settings(
        logistic=task == "classification", learning_rate=float(params["learning_rate"]),
        depth=int(params.get("max_depth", 0)) or int(leaves), leaves=int(leaves) if leaves else None,
        subsample=float(params.get("subsample", 1.0)), column_share=float(params.get("column_share", 1.0)),
        penalty=LEAF_PENALTY[name], least_curvature=LEAF_CURVATURE, seed=SEED)


def fit_boosted(name: str, task: str, params: Mapping[str, object], trains: Sequence[DataFrame], target: str, features: Sequence[str],
                labels: Sequence[str] = (), balanced: bool = False, key: Sequence[str] | None = None, trees: int = MAX_TREES,
                stop_early: bool = True, patience: int = boosting.PATIENCE) -> list[Fitted]:
    """One boosted model per training table, grown side by side: every pass over the data serves all of them.

    With ``stop_early`` a tenth of each table is held back, and a model ends once no tree of the last ``patience`` lowered the loss there.
    Each table has an encoder of its own. Two classes are one model, more are boosted one against the rest. Text columns of
    ``boosted_codes`` become ordered means of the target: of every class if there are more than two.
    """
    labels = [str(x) for x in labels]
    text = [c for c in features if c not in columns_of(trains[0], "numeric", "boolean")] if name == "boosted_codes" else []
    against = list(range(len(labels))) if len(labels) > 2 else [1] if labels else [None]

    def prepared(train: DataFrame) -> tuple[Fitted, DataFrame]:
        keys = default_key(train, key)
        if stop_early:
            train = early_stopping_slice(train, target, keys, task == "classification")
        marked = _weighted(train, task, target, labels, balanced).where(F.col("__y").isNotNull())
        marked = marked.withColumn("__id", F.xxhash64(*[q(c) for c in keys]))
        held = F.col("is_validation") if stop_early else F.lit(False)
        codes = None
        if text:
            marked, codes = _coded(marked, text, keys, labels, held)
        names = [c for c in features if c not in text] + (codes.names() if codes else [])
        encoder = Encoder.fit(marked.where(~held), names, STYLE[name])
        encoded = encoder.numbers(marked, "__x").select(
            F.col("__id").alias("id"), F.col("__x").alias("x"), "__y", F.col("__weight").alias("w"), held.alias("held"))
        return Fitted(name, task, dict(params), encoder, labels, codes=codes), encoded

    with ThreadPoolExecutor(PREPARED_AT_ONCE) as pool:
        made = list(pool.map(prepared, trains))
    out = [fitted for fitted, _ in made]
    width, parts = max(len(f.encoder.names()) for f in out), []
    for _, encoded in made:
        for c in against:
            y = F.col("__y") if c is None or len(labels) == 2 else (F.col("__y") == float(c)).cast("double")
            parts.append(encoded.select(F.lit(len(parts)).alias("model"), "id", "x", y.alias("y"), "w", "held"))
    # Folds may know different levels; a feature that a fold lacks is constant there.
    padded = F.concat("x", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("x")))
    rows = reduce(DataFrame.unionAll, parts).withColumn("x", padded)
    rows = written(rows, "boosting-rows")
    found = boosting.boost(rows, width, boosting_settings(name, task, params), trees, patience if stop_early else None)
    dropped(rows)
    for i, fitted in enumerate(out):
        fitted.ensembles = [found[i * len(against) + j] for j in range(len(against))]
        fitted.trees = max(len(e.trees) for e in fitted.ensembles)
    return out


def _coded(marked: DataFrame, text: Sequence[str], key: Sequence[str], labels: Sequence[str], held: Column) -> tuple[DataFrame, TargetCodes]:
    """Rows with their categories as numbers: in training from the rows before, on the rows held back from all training rows."""
    if len(labels) > 2:
        targets = {f"class_{i}": (F.col("__y") == float(i)).cast("double") for i in range(len(labels))}
    else:
        targets = {"target": F.col("__y")}
    marked = marked.withColumns(targets)
    used = marked.where(~held)
    codes = TargetCodes.fit(used, text, list(targets))
    codes.tables = [settled_levels(t) for t in codes.tables]
    coded = ordered_codes(used, text, list(targets), key)
    return coded.unionByName(codes.transform(marked.where(held))), codes


def settled_levels(table: DataFrame) -> DataFrame:
    """A table of levels, computed once: it is part of the model."""
    return written(table, "levels")


def boosted_cv(name: str, task: str, params: Mapping[str, object], data: DataFrame, target: str, features: Sequence[str], folds: int,
               metric: str, labels: Sequence[str] = (), balanced: bool = False, key: Sequence[str] | None = None,
               max_trees: int = MAX_TREES, patience: int = boosting.PATIENCE) -> list[float]:
    """The scores of all folds, whose models are grown side by side and stop on rows held back from their own training folds."""
    trains = [data.where(F.col("fold") != k) for k in range(folds)]
    fitted = fit_boosted(name, task, params, trains, target, features, labels, balanced, key, max_trees, patience=patience)
    return [_held_score(f, data.where(F.col("fold") == k), task, target, features, metric) for k, f in enumerate(fitted)]


def _held_score(fitted: Fitted, held: DataFrame, task: str, target: str, features: Sequence[str], metric: str) -> float:
    return score(metric, fitted.predict(_labelled(fitted, held, target, features)))


def _labelled(fitted: Fitted | Prepared, held: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """The features of rows that were held out, and their target as a number, ``label``."""
    y = label_index(fitted.labels, q(target)) if fitted.task == "classification" else q(target).cast("double")
    return held.select(*[q(c) for c in features], y.alias("label"))


def _fit_kernel(fitted: Fitted, data: DataFrame, width: int) -> kernel.KernelModel:
    """The kernel machine on standardised features; a numeric target is standardised too, so that the tube has one width."""
    gamma = fitted.params["gamma"]
    gamma = scale_gamma(data, width) if gamma == "scale" else float(gamma)
    y = F.col("__y")
    if fitted.task != "classification":
        middle, spread = data.agg(F.avg("__y"), F.stddev_pop("__y")).first()
        fitted.target_scale = (middle or 0.0, spread or 1.0)
        y = (y - fitted.target_scale[0]) / fitted.target_scale[1]
    # Landmarks are drawn by a hash of the row, which equal rows share: each kind of row must stand there once.
    keyed = _equal_rows(data).withColumn("__id", F.xxhash64(vector_to_array("features"), "__y"))
    rows = keyed.select(F.col("__id").alias("id"), vector_to_array("features").alias("x"), y.alias("y"), F.col("__weight").alias("w"))
    classes = max(2, len(fitted.labels)) if fitted.task == "classification" else 0
    return kernel.fit(rows, gamma, float(fitted.params["C"]), classes)


def _equal_rows(data: DataFrame, *also: str) -> DataFrame:
    """Rows of equal features and target as one of their weights together: a weighted loss does not tell them apart."""
    sums = data.groupBy(vector_to_array("features").alias("v"), "__y", *also).agg(F.sum("__weight").alias("__weight"))
    return sums.select(array_to_vector("v").alias("features"), "__y", "__weight")


def _fit_linear(fitted: Fitted, made: Prepared) -> Model:
    strength, data = float(fitted.params["strength"]), made.data
    if fitted.task == "classification":
        return LogisticRegression(featuresCol="features", labelCol="__y", weightCol="__weight", maxIter=200,
                                  regParam=logistic_penalty(strength, made.weight), elasticNetParam=0.0, standardization=False).fit(data)
    spread = data.agg(F.stddev_pop("__y")).first()[0] or 1.0
    return LinearRegression(featuresCol="features", labelCol="__y", regParam=ridge_penalty(strength, made.rows, spread), elasticNetParam=0.0,
                            standardization=False, solver="normal").fit(data)


# -- scores, folds, baseline -----------------------------------------------------------------


def score(metric: str, preds: DataFrame, label: str = "label", prediction: str = "prediction") -> float:
    """One selection metric of a prediction table."""
    if metric == "r2":
        value = M.regression_metrics(preds, label, prediction).first()["r2"]
    else:
        value = M.class_metrics(preds, label, prediction).first()[metric]
    return float(value) if value is not None else 0.0


def fold_score(name: str, task: str, params: Mapping[str, object], data: DataFrame, target: str,
               features: Sequence[str], fold: int, metric: str, labels: Sequence[str] = (), balanced: bool = False,
               key: Sequence[str] | None = None, **how) -> float:
    """Fit on every fold but one and score that one."""
    fitted = fit(name, task, params, data.filter(F.col("fold") != fold), target, features, labels, balanced, key, **how)
    return _held_score(fitted, data.filter(F.col("fold") == fold), task, target, features, metric)


def cross_validate(run: Callable[[int], float], folds: int, parallelism: int = 2) -> list[float]:
    """Scores of all folds; their Spark jobs run side by side."""
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(run, range(folds)))


def baseline_cv(data: DataFrame, target: str, task: str, fold: str = "fold") -> DataFrame:
    """``(fold, score)`` of guessing the training folds' majority class or mean, without fitting anything.

    Accuracy, macro F1 and R2 of a constant guess follow from counts and sums per fold.
    """
    if task == "regression":
        y = q(target).cast("double")
        centre = data.agg(F.avg(y)).first()[0] or 0.0
        cells = data.groupBy(q(fold).alias("fold")).agg(
            F.count(y).alias("n"), F.sum(y - centre).alias("s"), F.sum((y - centre) * (y - centre)).alias("ss"))
        everything = Window.partitionBy(F.lit(0))  # one row per fold
        guess = (F.sum("s").over(everything) - F.col("s")) / (F.sum("n").over(everything) - F.col("n"))
        sse = F.col("ss") - 2 * guess * F.col("s") + F.col("n") * guess * guess
        total = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
        return cells.select("fold", F.round(1 - sse / total, 6).alias("score"))
    cells = data.groupBy(q(fold).alias("fold"), q(target).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    # From here on the data is classes x folds, and every class gets a row in every fold.
    per_label = cells.groupBy("label").agg(
        F.sum("n").alias("all"), F.max("fold").alias("last"),
        F.map_from_entries(F.collect_list(F.struct("fold", "n"))).alias("held"))
    last = F.max("last").over(Window.partitionBy(F.lit(0)))  # one row per class
    dense = per_label.withColumn("last", last).select(
        "label", "all", "held", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("fold"))
    own = F.coalesce(F.col("held")[F.col("fold")], F.lit(0))
    train = dense.select("fold", "label", own.alias("own"), (F.col("all") - own).alias("train"))
    per_fold = train.groupBy("fold").agg(
        F.min_by(F.struct("label", "own"), F.struct(-F.col("train"), F.col("label"))).alias("usual"),
        F.sum("own").alias("rows"), F.count_if(F.col("own") > 0).alias("present"))
    hits = F.col("usual.own")
    classes = F.col("present") + F.when(hits == 0, 1).otherwise(0)  # classes in the truth or in the guess
    f1 = (2 * hits / (hits + F.col("rows"))) / classes
    # F1 of the guessed class is 2 * hits / (actual + predicted) = 2 * hits / (hits + rows).
    return per_fold.select("fold", F.col("usual.label").alias("usual"), F.round(hits / F.col("rows"), 6).alias("score"),
                           F.round(f1, 6).alias("f1_macro"))


def importances(fitted: Fitted, n: int = 10) -> DataFrame:
    """``(feature, importance)``, summing to one over all features; empty where a model has no weights."""
    spark = SparkSession.active()
    schema = "feature string, importance double"
    model = fitted.model
    if isinstance(model, (LogisticRegressionModel,)):
        values = np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    elif isinstance(model, LinearRegressionModel) and fitted.name == "linear":
        values = np.abs(model.coefficients.toArray())
    elif hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif fitted.ensembles:
        values = np.sum([e.importance() for e in fitted.ensembles], axis=0)
    else:
        return spark.createDataFrame([], schema)
    names = fitted.encoder.names()
    if len(values) != len(names) or values.sum() <= 0:
        return spark.createDataFrame([], schema)
    values = values / values.sum()
    top = sorted(zip(names, values.tolist()), key=lambda pair: -pair[1])[:n]
    return spark.createDataFrame([(f, round(v, 4)) for f, v in top], schema)


# -- saving ------------------------------------------------------------------------------------

_KINDS: dict[str, type] = {
    c.__name__: c for c in (
        RandomForestClassificationModel, RandomForestRegressionModel,
        LogisticRegressionModel, LinearRegressionModel)
}


def save(fitted: Fitted, path: str) -> None:
    """Write encoder, Spark ML model and settings next to each other, on any file system Spark can write."""
    spark = SparkSession.active()
    fitted.encoder.save(spark, f"{path}/encoder")
    meta = {
        "name": fitted.name, "task": fitted.task, "params": fitted.params, "labels": fitted.labels,
        "target_scale": fitted.target_scale, "trees": fitted.trees, "extra": fitted.extra, "borders": fitted.borders,
        "kind": type(fitted.model).__name__ if fitted.model is not None else None,
        "boosted": len(fitted.ensembles),
        "codes": [fitted.codes.columns, fitted.codes.targets, fitted.codes.means] if fitted.codes else None,
        "kernel": fitted.kernel.to_json() if fitted.kernel else None,
    }
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    if fitted.codes:
        for i, table in enumerate(fitted.codes.tables):
            table.write.mode("overwrite").parquet(f"{path}/codes_{i}")
    if fitted.ensembles:
        lines = [(e.to_json(),) for e in fitted.ensembles]
        spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/trees")
    if fitted.model is not None:
        fitted.model.write().overwrite().save(f"{path}/model")
    if fitted.neighbour_rows is not None:
        fitted.neighbour_rows.write.mode("overwrite").parquet(f"{path}/rows")


def load(path: str) -> Fitted:
    spark = SparkSession.active()
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    fitted = Fitted(meta["name"], meta["task"], meta["params"], Encoder.load(spark, f"{path}/encoder"), meta["labels"])
    fitted.target_scale, fitted.trees, fitted.extra = tuple(meta["target_scale"]), meta["trees"], meta["extra"]
    fitted.borders = meta.get("borders", [])
    if meta["kind"]:
        fitted.model = _KINDS[meta["kind"]].load(f"{path}/model")
    elif meta["kernel"]:
        fitted.kernel = kernel.KernelModel.from_json(meta["kernel"])
    elif meta["boosted"]:
        fitted.ensembles = [boosting.Ensemble.from_json(r["value"]) for r in spark.read.text(f"{path}/trees").collect()]
    else:
        fitted.neighbour_rows = spark.read.parquet(f"{path}/rows")
    if meta["codes"]:
        columns, targets, means = meta["codes"]
        fitted.codes = TargetCodes(columns, targets, means, [spark.read.parquet(f"{path}/codes_{i}") for i in range(len(columns))])
    return fitted


def class_labels(df: DataFrame, target: str) -> list[str]:
    """Class names in sorted order (numbers as numbers)."""
    return [str(v) if not isinstance(v, bool) else str(v).lower() for v, _ in class_table(df, target) or []]
