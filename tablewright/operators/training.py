"""The model sweep: split, cross-validate every candidate, tune the best, refit, score once."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.hashing import default_key
from tablewright.functions.kinds import q
from tablewright.operators import models, tuning
from tablewright.operators import metrics as M
from tablewright.operators.sampling import fold_count, require_class_sizes, train_test_split, with_folds
from tablewright.operators.task import TaskError, assess_imbalance
from tablewright.session import spread


@dataclass
class Sweep:
    """Everything a sweep produced."""

    champion: models.Fitted
    metric: str
    cv_mean: float
    train_score: float
    test_score: float
    baseline: float
    candidates: DataFrame
    trials: DataFrame
    predictions: DataFrame

    @property
    def beats_baseline(self) -> bool:
        return self.cv_mean > self.baseline + models.BASELINE_MARGIN

    @property
    def overfit_gap(self) -> float:
        return round(self.train_score - self.cv_mean, 4)


def sweep(df: DataFrame, target: str, task: str, candidates: Sequence[str] = ("boosted", "leafwise", "linear"),
          key: Sequence[str] | None = None, tuning_budget: float = 0, tuning_seconds: float = 300.0,
          time_budget: float | None = None, max_trees: int = models.MAX_TREES, parallelism: int = 2,
          neighbour_rows: int = models.neighbours.MAX_TRAIN_ROWS) -> Sweep:
    """Train on an engineered table. A candidate that fails is logged; the sweep fails only if all do."""
    started = time.monotonic()
    spark = df.sparkSession
    classification = task == "classification"
    features = [c for c in df.columns if c != target and c not in (key or [])]
    metric, balanced, labels = "r2", False, []
    if classification:
        require_class_sizes(df, target)
        facts = assess_imbalance(df, target).first()
        metric, balanced = facts["selection_metric"], facts["strategy"] is not None
        labels = models.class_labels(df, target)
    key = default_key(df, key)
    # Train and test rows are read many times; kept on disk where they do not fit in memory.
    split = spread(train_test_split(df, target, key, stratify=classification), df.count()).persist(StorageLevel.MEMORY_AND_DISK)
    train, test = split.filter("NOT is_test").drop("is_test"), split.filter("is_test").drop("is_test")
    if classification:
        require_class_sizes(train, target, 2)
    folds = fold_count(train, target, classification)
    rows = train.count()
    data = with_folds(train, target, key, classification, folds).persist(StorageLevel.MEMORY_AND_DISK)

    def one(name: str, params: dict, fold: int) -> float:
        return models.fold_score(name, task, params, data, target, features, fold, metric, labels, balanced, key,
                                 max_trees=max_trees, neighbour_rows=neighbour_rows)

    log: list[tuple] = []
    scores: dict[str, list[float]] = {}
    for name in candidates:
        if time_budget is not None and time.monotonic() - started > time_budget:
            log.append((name, "skipped", None, None, "the time budget is spent"))
            continue
        try:
            if name in models.BOOSTED:  # all folds share their passes over the data
                found = models.boosted_cv(name, task, models.DEFAULTS[name], data, target, features, folds, metric, labels, balanced, key, max_trees)
            else:
                found = models.cross_validate(lambda k: one(name, models.DEFAULTS[name], k), folds, parallelism)
        except Exception as error:
            log.append((name, "failed", None, None, str(error)[:300]))
            continue
        scores[name] = found
        mean = sum(found) / len(found)
        deviation = tuning.noise(found) * len(found) ** 0.5
        log.append((name, "ok", round(mean, 4), round(deviation, 4), None))
    schema = "name string, status string, cv_mean double, cv_std double, reason string"
    table = spark.createDataFrame(log, schema)
    if not scores:
        data.unpersist()
        split.unpersist()
        raise TaskError("No model could be trained: " + "; ".join(f"{r[0]}: {r[4]}" for r in log))
    best = max(scores, key=lambda n: sum(scores[n]) / len(scores[n]))
    start = sum(scores[best]) / len(scores[best])
    with models.FoldScores(best, task, data, target, features, folds, metric, labels, balanced, key, max_trees=max_trees,
                           neighbour_rows=neighbour_rows) as fold_scores:
        found = tuning.search(best, fold_scores, folds, rows // folds, models.DEFAULTS[best],
                              start, tuning_budget, tuning_seconds, tuning.noise(scores[best]))
    params = {**models.DEFAULTS[best], **found.params}
    final = models.fit(best, task, params, train, target, features, labels, balanced, key, max_trees=max_trees, neighbour_rows=neighbour_rows)

    def scored(rows_: DataFrame) -> DataFrame:
        y = models.label_index(labels, q(target)) if classification else q(target).cast("double")
        return final.predict(rows_.withColumn("label", y))

    predictions = scored(test)
    sums = models.baseline_cv(data, target, task).agg(F.avg("score"), F.avg("f1_macro") if classification else F.lit(0.0)).first()
    out = Sweep(
        final, metric, round(found.score, 4), models.score(metric, scored(train)), models.score(metric, predictions),
        round(sums[1] if metric == "f1_macro" else sums[0], 4), table, found.table(spark), predictions)
    data.unpersist()
    split.unpersist()
    return out


def leaderboard(result: Sweep) -> DataFrame:
    return M.leaderboard(result.candidates, result.metric)
