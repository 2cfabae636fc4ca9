"""Which learning task a target calls for, and how unbalanced its classes are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.kinds import is_float, kind, q

# Fixed values of the decision rules.
MIN_CLASS_LIMIT = 15
MAX_CLASS_LIMIT = 30
MAX_CLASSES = 100
MAX_CLASS_SHARE = 0.5
IMBALANCE_RATIO = 1.5


class TaskError(ValueError):
    """The asked-for task does not fit the data; the message is safe to show."""


def target_stats(df: DataFrame, target: str) -> DataFrame:
    """``(rows, unique)`` of the values that are not missing: distinct values first, so that a
    target with one dominant value is combined before the shuffle."""
    counts = df.filter(q(target).isNotNull()).groupBy(q(target).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("v").alias("unique"))


def detect_problem(df: DataFrame, target: str) -> DataFrame:
    """One row: the task, and the distinct count and limit behind it."""
    stats = target_stats(df, target)
    limit = F.least(
        F.greatest(F.lit(MIN_CLASS_LIMIT), F.floor(0.02 * F.col("rows"))), F.lit(MAX_CLASS_LIMIT)
    ).cast("bigint")
    if kind(df.schema[target]) not in ("numeric", "boolean"):
        decision: Column = F.lit("classification")
    elif is_float(df, target):
        decision = F.lit("regression")
    else:
        decision = F.when(F.col("unique") > limit, "regression").otherwise("classification")
    return stats.select(
        F.lit(target).alias("target"), decision.alias("problem_type"), "unique", "rows", limit.alias("class_limit")
    )


def accepts_override(df: DataFrame, target: str, proposed: str) -> DataFrame:
    """Whether a proposed task may replace the detected one, with the reason when not."""
    stats = target_stats(df, target)
    if proposed == "regression":
        numeric = kind(df.schema[target]) in ("numeric", "boolean")
        accepted = F.lit(numeric)
        reason = F.when(~accepted, "the target is not numeric")
    else:
        accepted = (F.col("unique") <= MAX_CLASSES) & (F.col("unique") <= MAX_CLASS_SHARE * F.col("rows"))
        reason = F.when(~accepted, F.concat(F.lit("too many distinct values: "), F.col("unique").cast("string")))
    return stats.select(
        F.lit(target).alias("target"), F.lit(proposed).alias("proposed"), "unique", "rows",
        accepted.alias("accepted"), reason.alias("reason"),
    )


def task_problem(df: DataFrame, task: str, target: str | None) -> str | None:
    """What keeps a task from being done on a table, in words for the user; None if nothing does.

    Checks that need only the schema come first; one needs the rows, and stops at one class too many.
    """
    if target is None or target not in df.columns:
        return f"pick a target among the columns: {target!r} is none" if target else "a target column is needed"
    numeric = kind(df.schema[target]) == "numeric"
    verdicts = {
        "auto": lambda: None,
        "regression": lambda: None if numeric else f"{target!r} holds no numbers to regress on",
        "classification": lambda: f"{target!r} has over {MAX_CLASSES} values, too many to be classes"
        if df.select(q(target)).na.drop().distinct().limit(MAX_CLASSES + 1).count() > MAX_CLASSES else None,
    }
    return verdicts[task]() if task in verdicts else f"{task!r} is no task; there are {', '.join(verdicts)}"


def resolve_task(df: DataFrame, task: str, target: str | None) -> str:
    """The task to do; raises :class:`TaskError` before any work starts if it cannot be done."""
    problem = task_problem(df, task, target)
    if problem:
        raise TaskError(problem[0].upper() + problem[1:] + ".")
    return detect_problem(df, target).first()["problem_type"] if task == "auto" else task


def assess_imbalance(df: DataFrame, target: str, task: str = "classification") -> DataFrame:
    """Class ratio, smallest class and its share, and the weighting and metric that follow."""
    if task != "classification":
        return df.sparkSession.range(1).select(
            F.lit(False).alias("applies"), F.lit(False).alias("detected"), F.lit(None).cast("double").alias("ratio"),
            F.lit(None).cast("string").alias("minority_class"), F.lit(None).cast("double").alias("minority_share"),
            F.lit(None).cast("string").alias("strategy"), F.lit("r2").alias("selection_metric"),
        )
    label = q(target).cast("string")
    counts = df.filter(q(target).isNotNull()).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    sums = counts.agg(
        F.max("n").alias("most"), F.min("n").alias("least"), F.sum("n").alias("rows"), F.count("n").alias("classes"),
        F.min_by("label", F.struct("n", "label")).alias("minority_class"),
    )
    ratio = F.when(F.col("classes") > 1, F.col("most") / F.col("least")).otherwise(1.0)
    detected = ratio > IMBALANCE_RATIO
    return sums.select(
        F.lit(True).alias("applies"),
        detected.alias("detected"),
        F.round(ratio, 2).alias("ratio"),
        "minority_class",
        F.round(F.col("least") / F.col("rows"), 4).alias("minority_share"),
        F.when(detected, "balanced_class_weights").alias("strategy"),
        F.when(detected, "f1_macro").otherwise("accuracy").alias("selection_metric"),
    )
