"""Scores of a prediction table and the result tables built from it.

Class metrics read the confusion counts, a table of classes squared; ranking metrics
read one row per distinct score with running totals; regression metrics are plain
aggregates. The prediction table itself is grouped once and never sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.kinds import q
from tablewright.operators.ordering import SMALL_ROWS, quantiles, running_totals
from tablewright.operators.sampling import uniform_sample
from tablewright.session import settled

# Fixed values.
MAX_BARS = 15
SCATTER_ROWS = 5_000
ERROR_BINS = 40
LOWER_IS_BETTER = ("rmse", "mae")


def higher_is_better(metric: str) -> bool:
    return metric not in LOWER_IS_BETTER


# -- classes ------------------------------------------------------------------------


def confusion_counts(preds: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(label, prediction, n)`` of the pairs that occur."""
    return preds.groupBy(
        q(label).cast("string").alias("label"), q(prediction).cast("string").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion(preds: DataFrame, label: str = "label", prediction: str = "prediction",
              classes: Sequence[str] | None = None) -> DataFrame:
    """Every cell of the matrix, empty ones too: ``(label, prediction, n, share)``, share within the label."""
    counts = confusion_counts(preds, label, prediction)
    if classes is None:
        sides = counts.select(F.explode(F.array("label", "prediction")).alias("c")).distinct()
        classes = sorted(r["c"] for r in sides.collect())  # classes of a task: bounded by the task check
    names = F.array(*[F.lit(str(c)) for c in classes])
    per_label = counts.groupBy("label").agg(
        F.map_from_entries(F.collect_list(F.struct("prediction", "n"))).alias("cells"), F.sum("n").alias("rows"))
    wanted = counts.sparkSession.createDataFrame([(str(c),) for c in classes], "label string")
    dense = wanted.join(per_label, "label", "left").select(
        "label", F.explode(names).alias("prediction"), "cells", F.coalesce("rows", F.lit(0)).alias("rows"))
    n = F.coalesce(F.col("cells")[F.col("prediction")], F.lit(0))
    share = F.coalesce(F.try_divide(n, F.col("rows")), F.lit(0.0))
    return dense.select("label", "prediction", n.alias("n"), F.round(share, 4).alias("share"))


def _per_class(counts: DataFrame) -> DataFrame:
    """``(class, precision, recall, f1, support)`` from confusion counts, 0 where undefined."""
    n = F.col("n")
    sides = counts.select(F.inline(F.array(
        F.struct(F.col("label").alias("class"), n.alias("actual"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), n).otherwise(0).alias("hits")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("actual"), n.alias("predicted"),
                 F.lit(0).cast("bigint").alias("hits")),
    )))
    sums = sides.groupBy("class").agg(
        F.sum("actual").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))
    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    return sums.select(
        "class", ratio(hits, predicted).alias("precision"), ratio(hits, support).alias("recall"),
        ratio(2 * hits, support + predicted).alias("f1"), "support")


def class_report(preds: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and rows of each class, then the macro and the weighted average."""
    per = settled(_per_class(confusion_counts(preds, label, prediction)))  # one row per class
    scores = ["precision", "recall", "f1"]
    macro = per.agg(*[F.avg(s).alias(s) for s in scores], F.sum("support").alias("support")).select(
        F.lit("Macro average").alias("class"), *scores, "support")
    weighted = per.agg(*[F.try_divide(F.sum(q(s) * q("support")), F.sum("support")).alias(s) for s in scores],
                       F.sum("support").alias("support")).select(F.lit("Weighted average").alias("class"), *scores, "support")
    whole = per.unionByName(macro).unionByName(weighted)
    return whole.select("class", *[F.round(s, 4).alias(s) for s in scores], F.col("support").alias("rows"))


def class_metrics(preds: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy, balanced accuracy and macro F1."""
    counts = confusion_counts(preds, label, prediction)
    per = _per_class(counts).agg(
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("f1_macro"),
        F.sum(F.col("recall") * F.col("support")).alias("hits"), F.sum("support").alias("rows"))
    return per.select(
        F.round(F.col("hits") / F.col("rows"), 6).alias("accuracy"), F.round("balanced_accuracy", 6).alias("balanced_accuracy"),
        F.round("f1_macro", 6).alias("f1_macro"))


def actual_vs_predicted(preds: DataFrame, label: str = "label", prediction: str = "prediction", n: int = MAX_BARS) -> DataFrame:
    """How often each class occurs and is predicted, largest classes first."""
    per = confusion_counts(preds, label, prediction).select(F.inline(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("a"), F.lit(0).cast("bigint").alias("p")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("a"), F.col("n").alias("p")),
    ))).groupBy("class").agg(F.sum("a").alias("actual"), F.sum("p").alias("predicted"))
    return per.orderBy(F.desc("actual"), "class").limit(n)


# -- ranking --------------------------------------------------------------------------


def score_steps(preds: DataFrame, positive: Column, score: Column, by: Column | None = None,
                rows: int | None = None, small: int = SMALL_ROWS) -> DataFrame:
    """Per distinct score, from the highest: true and false positives so far, and the totals.

    Rows of equal score are one step, so a score shared by many rows is a single row
    before any ordering happens.
    """
    by = F.lit("positive") if by is None else by
    steps = preds.groupBy(by.cast("string").alias("class"), score.cast("double").alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    rows = preds.count() if rows is None else rows
    run = running_totals(steps, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")}, ["class"], rows, small)
    # One row per class, and at most ten classes are drawn: the totals become literals.
    totals = preds.groupBy(by.cast("string").alias("class")).agg(
        F.count_if(positive).alias("p"), F.count_if(~positive).alias("n")).collect()
    none = F.lit(0).cast("bigint")
    positives, negatives = none, none
    for t in totals:
        own = F.col("class").eqNullSafe(F.lit(t["class"]))
        positives, negatives = F.when(own, F.lit(t["p"])).otherwise(positives), F.when(own, F.lit(t["n"])).otherwise(negatives)
    return run.withColumns({"positives": positives, "negatives": negatives})


def roc_auc(steps: DataFrame) -> DataFrame:
    """Area under the ROC curve per class: every step's trapezoid, which is the rank-sum statistic."""
    area = (F.col("tp") - F.col("pos") / 2) * F.col("neg")
    sums = steps.groupBy("class").agg(
        F.sum(area).alias("area"), F.first("positives").alias("p"), F.first("negatives").alias("n"))
    return sums.select("class", F.round(F.try_divide(F.col("area"), F.col("p") * F.col("n")), 6).alias("roc_auc"))


def average_precision(steps: DataFrame) -> DataFrame:
    """Sum of precision times the gain in recall (a step sum, not a trapezoid)."""
    gain = F.try_divide(F.col("pos"), F.col("positives")) * F.col("tp") / (F.col("tp") + F.col("fp"))
    return steps.groupBy("class").agg(F.round(F.sum(gain), 6).alias("average_precision"))


def roc_points(steps: DataFrame) -> DataFrame:
    """``(class, threshold, fpr, tpr)`` at every distinct score."""
    return steps.select(
        "class", F.col("score").alias("threshold"),
        F.round(F.try_divide(F.col("fp"), F.col("negatives")), 6).alias("fpr"),
        F.round(F.try_divide(F.col("tp"), F.col("positives")), 6).alias("tpr"))


def pr_points(steps: DataFrame) -> DataFrame:
    """``(class, threshold, recall, precision, no_model)``; the last is the share of positives."""
    return steps.select(
        "class", F.col("score").alias("threshold"),
        F.round(F.try_divide(F.col("tp"), F.col("positives")), 6).alias("recall"),
        F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"),
        F.round(F.col("positives") / (F.col("positives") + F.col("negatives")), 6).alias("no_model"))


def one_vs_rest(preds: DataFrame, label: str, scores: str, classes: Sequence[str]) -> DataFrame:
    """One row per row and class: whether it is the class, and its score."""
    cells = F.array(*[
        F.struct(F.lit(str(c)).alias("class"), (q(label).cast("string") == str(c)).alias("is_class"),
                 q(scores)[i].alias("class_score"))
        for i, c in enumerate(classes)
    ])
    return preds.select(F.inline(cells))


# -- regression ---------------------------------------------------------------------------


def _regression_sums(label: Column, prediction: Column) -> dict[str, Column]:
    error = label - prediction
    sse, n = F.sum(error * error), F.count(error)
    return {
        "r2": F.round(1 - F.try_divide(sse, F.var_pop(label) * n), 6),
        "rmse": F.round(F.sqrt(sse / n), 6),
        "mae": F.round(F.avg(F.abs(error)), 6),
    }


def regression_metrics(preds: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, p = q(label).cast("double"), q(prediction).cast("double")
    return preds.agg(*[e.alias(n) for n, e in _regression_sums(y, p).items()])


def held_out_table(preds: DataFrame, label: str = "label", prediction: str = "prediction", rows: int | None = None,
                   **sizes) -> DataFrame:
    """``(metric, value)``: the regression scores, median and largest error, share within 10 %, rows."""
    y, p = q(label).cast("double"), q(prediction).cast("double")
    errors = preds.select(y.alias("y"), p.alias("p"), F.abs(y - p).alias("error"))
    middle = quantiles(errors, ["error"], [0.5], rows, **sizes)["error"]
    exprs = _regression_sums(F.col("y"), F.col("p"))
    exprs["median_absolute_error"] = F.round(middle[0], 6)
    exprs["largest_error"] = F.round(F.max("error"), 6)
    exprs["within_10_percent"] = F.round(F.avg((F.col("error") <= 0.1 * F.abs("y")).cast("double")), 6)
    exprs["rows"] = F.count(F.lit(1)).cast("double")
    wide = errors.agg(*[e.alias(f"m{i}") for i, e in enumerate(exprs.values())])
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"m{i}").alias("value")) for i, n in enumerate(exprs)])
    return wide.select(F.inline(pairs))


def residuals(preds: DataFrame, key: Sequence[str], label: str = "label", prediction: str = "prediction",
              n: int = SCATTER_ROWS) -> DataFrame:
    """At most ``n`` of the rows, the same on every run: actual, predicted and the difference."""
    y, p = q(label).cast("double"), q(prediction).cast("double")
    sample = uniform_sample(preds, n, key, seed=0)
    return sample.select(*[q(k) for k in key], y.alias("actual"), p.alias("predicted"), (y - p).alias("residual"))


def axis_range(preds: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, p = q(label).cast("double"), q(prediction).cast("double")
    return preds.agg(F.least(F.min(y), F.min(p)).alias("low"), F.greatest(F.max(y), F.max(p)).alias("high"))


def error_histogram(preds: DataFrame, label: str = "label", prediction: str = "prediction", bins: int = ERROR_BINS) -> DataFrame:
    """Rows per equal-width bin of the error: ``(bin, low, n)``, empty bins left out."""
    errors = preds.select((q(label).cast("double") - q(prediction).cast("double")).alias("e"))
    ends = errors.agg(F.min("e").alias("lo"), F.max("e").alias("hi")).first()
    if ends["lo"] is None:
        return errors.sparkSession.createDataFrame([], "bin bigint, low double, n bigint")
    lo, width = ends["lo"], (ends["hi"] - ends["lo"]) or 1.0
    spot = F.least(F.floor((F.col("e") - lo) / width * bins), F.lit(bins - 1)).cast("bigint")
    counts = errors.filter("e IS NOT NULL").groupBy(spot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin", F.round(lo + F.col("bin") * width / bins, 6).alias("low"), "n")


# -- tables of candidates and trials ----------------------------------------------------------


def cv_summary(scores: DataFrame, by: str = "name", score: str = "score") -> DataFrame:
    """``(name, cv_mean, cv_std, cv_noise)`` of a table of fold scores; noise is the error of the mean."""
    mean, std = F.avg(score), F.stddev_pop(score)
    return scores.groupBy(q(by).alias("name")).agg(
        F.round(mean, 4).alias("cv_mean"), F.round(std, 4).alias("cv_std"),
        F.round(std / F.sqrt(F.count(score)), 6).alias("cv_noise"))


def leaderboard(candidates: DataFrame, metric: str = "accuracy", n: int | None = None) -> DataFrame:
    """Candidates that trained, best first."""
    best = F.desc("cv_mean") if higher_is_better(metric) else F.asc("cv_mean")
    ok = candidates.filter("status = 'ok'") if "status" in candidates.columns else candidates
    ranked = ok.orderBy(best, "name")
    return ranked.limit(n) if n else ranked


def excluded(candidates: DataFrame) -> DataFrame:
    return candidates.filter("status <> 'ok'").select("name", "status", "reason").orderBy("name")


def champion(candidates: DataFrame, metric: str = "accuracy") -> DataFrame:
    return leaderboard(candidates, metric, 1)


def beats_baseline(score: Column, baseline: Column, metric: str = "accuracy", margin: float = 0.01) -> Column:
    return score > baseline + margin if higher_is_better(metric) else score < baseline - margin


def overfit_gap(train_score: Column, cv_mean: Column) -> Column:
    return F.round(train_score - cv_mean, 4)


def tuning_progress(trials: DataFrame, metric: str = "accuracy", rows: int | None = None) -> DataFrame:
    """``(trial, score, best)``: the best score up to each trial. A trial log has one row per trial."""
    scored = trials.filter("score IS NOT NULL")
    so_far = Window.partitionBy(F.lit(0)).orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)
    best = F.max("score") if higher_is_better(metric) else F.min("score")
    return scored.select("trial", "score", best.over(so_far).alias("best"))


def tuning_summary(trials: DataFrame, metric: str = "accuracy") -> DataFrame:
    """One row: the first and the best score, their difference, and whether it counts as a gain."""
    best = F.max("score") if higher_is_better(metric) else F.min("score")
    sums = trials.filter("score IS NOT NULL").agg(
        F.min_by("score", "trial").alias("first"), best.alias("best"), F.count_if(F.col("trial") > 0).alias("searched"))
    delta = F.col("best") - F.col("first")
    improved = delta > 0.0001 if higher_is_better(metric) else delta < -0.0001
    return sums.select("first", "best", F.round(delta, 6).alias("delta"), improved.alias("improved"), "searched")


def result_tables(preds: DataFrame, task: str, key: Sequence[str], classes: Sequence[str] = (),
                  scores: str | None = None, candidates: DataFrame | None = None, trials: DataFrame | None = None,
                  importances: DataFrame | None = None, metric: str = "accuracy") -> dict[str, DataFrame]:
    """Every result table the run's data allows, in display order."""
    out: dict[str, DataFrame] = {}
    if task == "classification":
        out["confusion_matrix"] = confusion(preds, classes=list(classes) or None)
        out["class_metrics"] = class_report(preds)
        if scores and len(classes) == 2:
            positive = q("label").cast("string") == str(classes[1])
            steps = score_steps(preds, positive, q(scores)[1])
            out["roc_curve"], out["precision_recall"] = roc_points(steps), pr_points(steps)
        elif scores:
            long = one_vs_rest(preds, "label", scores, classes)
            steps = score_steps(long, F.col("is_class"), F.col("class_score"), F.col("class"))
            steps = steps.filter("positives > 0 AND negatives > 0")
            out["roc_curve"], out["precision_recall"] = roc_points(steps), pr_points(steps)
        out["class_counts"] = actual_vs_predicted(preds)
        out["test_metrics"] = class_metrics(preds)
    else:
        out["predicted_vs_actual"] = out["residuals"] = residuals(preds, key)
        out["error_distribution"] = error_histogram(preds)
        out["test_metrics"] = held_out_table(preds)
    if importances is not None:
        out["feature_importance"] = importances.orderBy(F.desc("importance"), "feature").limit(MAX_BARS)
    if candidates is not None and candidates.limit(2).count() > 1:
        out["model_comparison"] = leaderboard(candidates, metric, MAX_BARS)
    if trials is not None and trials.filter("score IS NOT NULL").limit(2).count() > 1:
        out["tuning"] = tuning_progress(trials, metric)
    return out
