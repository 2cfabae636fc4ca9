"""Column profiles, table health, row search and the exploratory summary."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.kinds import as_text, columns_of, q
from tablewright.operators.ordering import quantiles

SUMMARY_SHARES = (0.25, 0.5, 0.75)


def rows_per_column(exprs: dict[str, dict[str, Column]], df: DataFrame, key: str = "column") -> DataFrame:
    """One aggregate over the table, returned as one row per column.

    ``exprs`` maps a column name to its named aggregates. The result of the single
    pass is one row, unfolded by ``inline``; the number of jobs does not depend on
    the number of columns.
    """
    flat = {f"a{i}_{j}": (e, n) for i, row in enumerate(exprs.values()) for j, (n, e) in enumerate(row.items())}
    wide = df.agg(*[e.alias(a) for a, (e, _) in flat.items()])
    structs = [
        F.struct(F.lit(name).alias(key), *[F.col(f"a{i}_{j}").alias(n) for j, n in enumerate(row)])
        for i, (name, row) in enumerate(exprs.items())
    ]
    return wide.select(F.inline(F.array(*structs)))


LONG_VALUE = 32  # bytes; a longer value can be stood for by its digest


def value_counts(df: DataFrame, columns: Sequence[str] | None = None, digests: bool = False) -> DataFrame:
    """``(column, value, n)`` for every column at once: one scan, one shuffle of pre-summed counts.

    With ``digests`` a long value is replaced by its digest, for counts that do not need the values.
    """
    columns = list(columns or df.columns)
    long = df.select(*as_text(df, columns)).unpivot([], [q(c) for c in columns], "column", "value")
    if digests:
        long = long.withColumn("value", F.when(F.octet_length("value") > LONG_VALUE, F.concat(F.lit("#"), F.md5("value")))
                               .otherwise(F.col("value")))
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, dtype, rows, missing, unique)`` with exact distinct counts."""
    columns = list(columns or df.columns)
    dtypes = dict(df.dtypes)
    names = F.create_map(*[F.lit(x) for c in columns for x in (c, dtypes[c])])
    return (
        value_counts(df, columns, digests=True)
        .groupBy("column")
        .agg(
            F.sum("n").alias("rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
            F.count("value").alias("unique"),
        )
        .select("column", names[F.col("column")].alias("dtype"), "rows", "missing", "unique")
    )


def first_values(df: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None, n: int = 3) -> DataFrame:
    """The first ``n`` values that are not missing, per column, in row order.

    One scan for all columns; every task keeps its first ``n`` per column before the shuffle.
    """
    columns = list(columns or df.columns)
    keys = [f"__o{i}" for i in range(len(order))]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), v.alias("value")) for c, v in zip(columns, as_text(df, columns))])
    long = df.select(*[q(o).alias(k) for o, k in zip(order, keys)], F.inline(cells)).filter("value IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("column").orderBy(*keys, "value"))
    top = long.withColumn("__place", place).filter(F.col("__place") <= n)
    samples = top.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("__place", "value"))).alias("s"))
    asked = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return asked.join(samples, "column", "left").select(
        "column", F.coalesce(F.transform("s", lambda p: p["value"]), F.array().cast("array<string>")).alias("sample"))


def preview_stats(df: DataFrame) -> DataFrame:
    """Per column: mean, population deviation, min and max of numbers, share missing, distinct values."""
    counts = profile(df)
    numeric = columns_of(df, "numeric")
    exprs = {
        c: {
            "mean": F.round(F.avg(v), 2), "std": F.round(F.stddev_pop(v), 2),
            "min": F.round(F.min(v), 2), "max": F.round(F.max(v), 2),
        }
        for c in numeric
        for v in [q(c).cast("double")]
    }
    share = F.round(100.0 * F.col("missing") / F.col("rows"), 1).alias("null_pct")
    base = counts.select("column", share, "unique")
    if not exprs:
        return base
    return base.join(F.broadcast(rows_per_column(exprs, df)), "column", "left")  # one row per numeric column


def table_health(df: DataFrame) -> DataFrame:
    """Missing cells, rows with a missing cell, and the percentage of filled cells."""
    gaps = sum((q(c).isNull().cast("int") for c in df.columns), F.lit(0))
    width = len(df.columns)
    sums = df.select(gaps.alias("gaps")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum("gaps"), F.lit(0)).alias("null_cells"),
        F.count_if(F.col("gaps") > 0).alias("null_rows"),
    )
    cells = F.col("rows") * width
    filled = F.floor(100.0 * (cells - F.col("null_cells")) / cells + 0.5)
    return sums.withColumn("health", F.when(cells > 0, filled).otherwise(100).cast("bigint"))


def search_rows(df: DataFrame, query: str) -> DataFrame:
    """Rows in which any column holds the query, ignoring case."""
    needle = query.strip().lower()
    if not needle:
        return df
    hits = [F.coalesce(F.lower(c).contains(needle), F.lit(False)) for c in as_text(df, df.columns)]
    return df.filter(reduce(lambda a, b: a | b, hits))


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None, rows: int | None = None, **sizes) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max, to four decimals."""
    columns = list(columns or columns_of(df, "numeric"))
    marks = quantiles(df, columns, SUMMARY_SHARES, rows, **sizes)
    exprs = {}
    for c in columns:
        v = q(c).cast("double")
        exprs[c] = {
            "count": F.count(v), "mean": F.round(F.avg(v), 4), "std": F.round(F.stddev_samp(v), 4),
            "min": F.round(F.min(v), 4), "marks": marks[c], "max": F.round(F.max(v), 4),
        }
    out = rows_per_column(exprs, df)
    cuts = [F.round(F.col("marks")[i], 4).alias(f"p{int(s * 100)}") for i, s in enumerate(SUMMARY_SHARES)]
    return out.select("column", "count", "mean", "std", "min", *cuts, "max")


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    v = q(target).cast("double")
    return df.agg(
        F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )


def top_correlations(df: DataFrame, target: str, n: int = 10) -> DataFrame:
    """The numeric columns most correlated with the target; each pair uses its own complete rows."""
    others = [c for c in columns_of(df, "numeric", "boolean") if c != target]
    y = q(target).cast("double")
    exprs = {c: {"correlation": F.round(F.corr(q(c).cast("double"), y), 4)} for c in others}
    ranked = rows_per_column(exprs, df)
    strength = F.coalesce(F.abs(F.nanvl("correlation", F.lit(0.0))), F.lit(0.0))
    return ranked.orderBy(strength.desc(), "column").limit(n)


def class_counts(df: DataFrame, target: str, n: int = 20) -> DataFrame:
    """The largest classes; equal counts go by label."""
    counts = df.filter(q(target).isNotNull()).groupBy(q(target).cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "label").limit(n)


def missing_per_column(df: DataFrame) -> DataFrame:
    return rows_per_column({c: {"missing": F.count_if(q(c).isNull())} for c in df.columns}, df)
