"""Data-quality checks. Each gives findings: ``(check, severity, column, value, detail)``.

The column checks all read one profile, so the table is scanned once for them; the
text-pattern checks add one aggregate for all text columns together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import values as V
from tablewright.functions.hashing import digest
from tablewright.functions.kinds import columns_of, is_integer, q
from tablewright.operators import leakage, task as task_ops
from tablewright.operators.profile import profile, rows_per_column
from tablewright.session import settled, spread, written

# Fixed values.
RARE_CLASS_ROWS = 10
SKEW_LIMIT = 2.0
MISSING_SHARE = 0.5
IDENTIFIER_SHARE = 0.95
TEXT_SHARE = 0.9
SEVERITIES = ("critical", "warning", "info")
IDENTIFIER_BUCKET = 1 << 20


def finding(df: DataFrame, check: str, severity: str, column: Column | str | None, value: Column, detail: Column) -> DataFrame:
    column = F.lit(column) if column is None or isinstance(column, str) else column
    return df.select(
        F.lit(check).alias("check"), F.lit(severity).alias("severity"), column.cast("string").alias("column"),
        value.cast("double").alias("value"), detail.cast("string").alias("detail"),
    )


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def target_missing(df: DataFrame, target: str) -> DataFrame:
    """Rows without a target; the value is their percentage."""
    sums = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(q(target).isNull()).alias("n")).filter("n > 0")
    share = V.pct(F.col("n"), F.col("rows"))
    return finding(sums, "target_missing", "warning", target, share,
                   _say(F.col("n"), " rows have no target value and are left out of training"))


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """Largest to smallest class above the limit; the value is the ratio."""
    found = task_ops.assess_imbalance(df, target).filter("detected")
    return finding(found, "class_imbalance", "warning", target, F.col("ratio"),
                   _say("the smallest class is ", F.col("minority_class"), "; weights and macro F1 will be used"))


def rare_classes(df: DataFrame, target: str, least: int = RARE_CLASS_ROWS) -> DataFrame:
    """One finding per class with too few rows; the value is its row count."""
    counts = df.filter(q(target).isNotNull()).groupBy(q(target).cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("n") < least)
    return finding(counts, "rare_classes", "warning", target, F.col("n"),
                   _say("class ", F.col("label"), " has ", F.col("n"), " rows"))


def sample_skewness(value: Column) -> Column:
    """Bias-corrected skewness, from Spark's population skewness."""
    n = F.count(value).cast("double")
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def target_skew(df: DataFrame, target: str, limit: float = SKEW_LIMIT) -> DataFrame:
    skew = df.agg(F.round(sample_skewness(q(target).cast("double")), 2).alias("skew"))
    return finding(skew.filter(F.abs("skew") > limit), "target_skew", "info", target, F.col("skew"),
                   _say("the largest values will dominate squared errors"))


def duplicate_counts(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row: rows, copies of an earlier row, and rows that repeat features with another target.

    Rows are known by 128-bit digests of their features and of their target, so that the shuffle does
    not carry the table; distinct rows come first, and the second grouping sees each of them once.
    """
    features = [c for c in df.columns if c != target]
    marks = df.select(digest(df, features).alias("f"), (digest(df, [target]) if target else F.lit("")).alias("t"))
    versions = marks.groupBy("f", "t").agg(F.count(F.lit(1)).alias("n"))
    return versions.groupBy("f").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("versions")).agg(
        F.sum("n").alias("rows"), (F.sum("n") - F.sum("versions")).alias("duplicates"),
        (F.sum("versions") - F.count(F.lit(1))).alias("conflicts"))


def duplicate_rows(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    counts = (counts if counts is not None else duplicate_counts(df)).filter("duplicates > 0")
    return finding(counts, "duplicate_rows", "warning", None, F.col("duplicates"),
                   _say(F.col("duplicates"), " rows are copies of another row"))


def conflicting_rows(df: DataFrame, target: str, counts: DataFrame | None = None) -> DataFrame:
    counts = (counts if counts is not None else duplicate_counts(df, target)).filter("conflicts > 0")
    return finding(counts, "conflicting_rows", "info", None, F.col("conflicts"),
                   _say(F.col("conflicts"), " rows repeat another row's features with a different target"))


def constant_columns(stats: DataFrame) -> DataFrame:
    """``stats`` is a profile; the value is the number of distinct values."""
    return finding(stats.filter("unique <= 1"), "constant_column", "info", F.col("column"), F.col("unique"),
                   _say(F.col("unique"), " distinct value(s): no signal"))


def high_missing(stats: DataFrame, share: float = MISSING_SHARE) -> DataFrame:
    found = stats.filter((F.col("unique") > 1) & (F.col("missing") > share * F.col("rows")))
    value = V.pct(F.col("missing"), F.col("rows"))
    return finding(found, "high_missing", "info", F.col("column"), value, _say(value, "% missing"))


def row_identifier(df: DataFrame, order: str, columns: Sequence[str] | None = None,
                   bucket: int = IDENTIFIER_BUCKET) -> DataFrame:
    """Integer columns that rise (or fall) strictly from row to row in the order of a unique integer column.

    Strictly rising means unique, so no distinct count is needed. Rows are compared
    inside ranges of about ``bucket`` rows by their place in the order, however sparse its
    values are; the ends of the ranges are compared in a table of one row per range.
    """
    columns = list(columns or [c for c in df.columns if is_integer(df, c)])
    steps = Window.partitionBy("__range").orderBy("__order")
    keyed = df.select(
        q(order).cast("bigint").alias("__order"), *[q(c).cast("bigint").alias(f"c{i}") for i, c in enumerate(columns)])
    ranges = max(1, -(-keyed.count() // bucket))
    # Written once: the range borders come from a sample and must not be drawn again.
    keyed = written(keyed.repartitionByRange(ranges, "__order").withColumn("__range", F.spark_partition_id()), "ranges")
    change = keyed.select("__range", "__order", *[f"c{i}" for i in range(len(columns))], *[
        (F.col(f"c{i}") - F.lag(f"c{i}").over(steps)).alias(f"d{i}") for i in range(len(columns))])
    per_range = change.groupBy("__range").agg(F.count(F.lit(1)).alias("n"), *[
        e for i in range(len(columns)) for e in (
            F.count(f"c{i}").alias(f"n{i}"), F.min(f"d{i}").alias(f"lo{i}"), F.max(f"d{i}").alias(f"hi{i}"),
            F.min_by(f"c{i}", "__order").alias(f"first{i}"), F.max_by(f"c{i}", "__order").alias(f"last{i}"))])
    ends = Window.partitionBy(F.lit(0)).orderBy("__range")  # one row per range
    joins = per_range.select("*", *[
        (F.col(f"first{i}") - F.lag(f"last{i}").over(ends)).alias(f"j{i}") for i in range(len(columns))])
    checks = {}
    for i, c in enumerate(columns):
        full = F.sum(f"n{i}") == F.sum("n")
        rises = F.coalesce(F.least(F.min(f"lo{i}"), F.min(f"j{i}")), F.lit(1)) > 0
        falls = F.coalesce(F.greatest(F.max(f"hi{i}"), F.max(f"j{i}")), F.lit(-1)) < 0
        checks[c] = {"hit": full & (rises | falls)}
    found = rows_per_column(checks, joins).filter("hit")
    return finding(found, "row_identifier", "warning", F.col("column"), F.lit(1.0),
                   _say("unique and ordered like the rows: a row number or ID"))


def temporal_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Date and time columns, by type; with rows in time order a random split can see the future.
    The value is the number of filled rows."""
    names = [c for c in (columns or df.columns) if c in columns_of(df, "temporal")]
    if not names:
        empty = df.sparkSession.createDataFrame([], "column string, filled bigint")
        return finding(empty, "temporal_column", "warning", F.col("column"), F.col("filled"), _say(""))
    rows = rows_per_column({c: {"filled": F.count(q(c))} for c in names}, df)
    return finding(rows, "temporal_column", "warning", F.col("column"), F.col("filled"), _say("a date or time column"))


def identifier_like(stats: DataFrame, text: Sequence[str], share: float = IDENTIFIER_SHARE) -> DataFrame:
    filled = F.col("rows") - F.col("missing")
    found = stats.filter(F.col("column").isin(list(text)) & (F.col("unique") > 1) & (F.col("unique") >= share * filled))
    return finding(found, "identifier_like", "info", F.col("column"), F.col("unique"),
                   _say(F.col("unique"), " distinct values in ", filled, " rows"))


def text_patterns(df: DataFrame, columns: Sequence[str], formats: Mapping[str, str] = V.DATE_FORMATS) -> DataFrame:
    """Per text column, the share of values that are numbers once decoration is removed, and the
    share of the other values that read as dates. Every value counts; nothing is sampled."""
    df = spread(df.select(*[q(c) for c in columns]), df.count())
    exprs = {}
    for c in columns:
        value = q(c).cast("string")
        bare = F.regexp_replace(value, V.NUMBER_DECORATION, "")
        plain = value.rlike(V.NUMBER_PATTERN)
        stamp = V.parse_timestamp(value, df.schema[c].dataType, formats).isNotNull()
        exprs[c] = {
            "filled": F.count(value),
            "numbers": F.count_if(bare.rlike(V.NUMBER_PATTERN)),
            "words": F.count_if(~plain),
            "dates": F.count_if(~plain & stamp),
        }
    sums = rows_per_column(exprs, df)
    return sums.select(
        "column",
        F.coalesce(F.try_divide(F.col("numbers"), F.col("filled")), F.lit(0.0)).alias("number_share"),
        F.coalesce(F.try_divide(F.col("dates"), F.col("words")), F.lit(0.0)).alias("date_share"),
    )


def numeric_stored_as_text(patterns: DataFrame, share: float = TEXT_SHARE) -> DataFrame:
    value = F.round(100.0 * F.col("number_share"), 2)
    return finding(patterns.filter(F.col("number_share") >= share), "numeric_stored_as_text", "warning",
                   F.col("column"), value, _say(value, "% of values are numbers once separators and signs are removed"))


def dates_stored_as_text(patterns: DataFrame, share: float = TEXT_SHARE) -> DataFrame:
    found = patterns.filter((F.col("number_share") < share) & (F.col("date_share") >= share))
    value = F.round(100.0 * F.col("date_share"), 2)
    return finding(found, "temporal_column", "warning", F.col("column"), value, _say(value, "% of values read as dates"))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def report(findings: Sequence[DataFrame]) -> DataFrame:
    """All findings, most severe first."""
    union = reduce(DataFrame.unionByName, findings)
    return union.orderBy(severity_rank(F.col("severity")), "check", "column", "value")


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def column_findings(df: DataFrame, target: str | None = None, stats: DataFrame | None = None) -> list[DataFrame]:
    """The checks that read the profile, plus the text patterns of columns that are not identifiers."""
    features = [c for c in df.columns if c != target]
    stats = settled(profile(df, features) if stats is None else stats)  # one row per column
    text = [c for c in features if c in columns_of(df, "text", "boolean", "nested")]
    out = [constant_columns(stats), high_missing(stats), identifier_like(stats, text),
           temporal_columns(df, features)]
    plain = [c for c in text if c in columns_of(df, "text")]
    if plain:
        judged = [r["column"] for r in stats.collect()
                  if r["unique"] > 1 and r["unique"] < IDENTIFIER_SHARE * (r["rows"] - r["missing"])]
        plain = [c for c in plain if c in judged]
    if plain:
        patterns = settled(text_patterns(df, plain))  # one row per column
        out += [numeric_stored_as_text(patterns), dates_stored_as_text(patterns)]
    return out


def audit(df: DataFrame, target: str, task: str, key: Sequence[str] | None = None,
          order: str | None = None, leaks: bool = True) -> DataFrame:
    """The whole report: target, rows, columns, and (optionally) leakage."""
    features = [c for c in df.columns if c != target]
    counts = settled(duplicate_counts(df, target))  # one row
    findings = [target_missing(df, target), duplicate_rows(df, counts), conflicting_rows(df, target, counts)]
    if task == "classification":
        findings += [class_imbalance(df, target), rare_classes(df, target)]
    elif target in columns_of(df, "numeric"):
        findings.append(target_skew(df, target))
    findings += column_findings(df, target)
    if order:
        integers = [c for c in features if is_integer(df, c)]
        if integers:
            findings.append(row_identifier(df, order, integers))
    if leaks:
        findings += leak_findings(df, target, task, key)
    return report(findings)


def leak_findings(df: DataFrame, target: str, task: str, key: Sequence[str] | None = None) -> list[DataFrame]:
    suspects = leakage.leakage_suspects(df, target, task, key)
    rows = suspects.collect()  # at most one row per feature
    spark = df.sparkSession
    found = spark.createDataFrame([(r["column"], r["score"]) for r in rows], "column string, score double")
    out = [finding(found, "leakage_suspect", "critical", F.col("column"), F.col("score"),
                   _say("this column alone predicts the target; check when it becomes known"))]
    names = [r["column"] for r in rows]
    number = leakage.formula_target(df, target, task, names)
    if number is not None:
        rest = [c for c in df.columns if c not in (*names, target)]
        formula = leakage.formula_leak(df, number, rest, key or df.columns)
        if formula:
            one = spark.createDataFrame([(formula.describe(target), formula.r2)], "line string, r2 double")
            out.append(finding(one, "leakage_formula", "critical", None, F.col("r2"),
                               _say("columns rebuild the target by arithmetic: ", F.col("line"))))
    return out
