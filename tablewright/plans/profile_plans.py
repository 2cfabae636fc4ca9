"""Profiles, exploration and task detection."""

from pyspark.sql import functions as F

from tablewright.operators import profile as P
from tablewright.operators import task as K
from tablewright.plans.base import (
    LINE_KEY, SQL_LABELLED, SQL_LINE_GAPS, SQL_LINE_TOTAL, SQL_ORDER_FACTS, labelled_documents, line_gaps, line_total,
    order_facts, query, table,
)

LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_NUMBERS = LINE_COLUMNS[:8]


def _per_column(source: str, columns: list[str], select: str) -> str:
    """One SELECT per column, joined by UNION ALL; ``{c}`` is the column."""
    ctes = f"WITH src AS ({source})"
    return ctes + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {select.format(c=c)} FROM src" for c in columns)


DTYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
          "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
          "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}


@query("profile_columns", "WITH src AS (" + SQL_LINE_GAPS + ") " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) AS rows, count(*) - count({c}) AS missing, "
    f"count(DISTINCT {c}) AS \"unique\" FROM src" for c, t in DTYPES.items()))
def profile_columns(spark, folder):
    return P.profile(line_gaps(spark, folder))


@query("profile_samples", "WITH src AS (" + SQL_LINE_GAPS + ") " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", string_agg(v, '|' ORDER BY r) AS sample FROM (SELECT {c}::VARCHAR AS v, "
    f"row_number() OVER (ORDER BY {', '.join(LINE_KEY)}, l_extendedprice) AS r FROM src WHERE {c} IS NOT NULL) WHERE r <= 3"
    for c in ["l_tax", "l_discount", "l_returnflag", "l_partkey"]))
def profile_samples(spark, folder):
    found = P.first_values(line_gaps(spark, folder), [*LINE_KEY, "l_extendedprice"],
                           ["l_tax", "l_discount", "l_returnflag", "l_partkey"])
    return found.select("column", F.concat_ws("|", "sample").alias("sample"))


@query("preview_stats", "WITH src AS (SELECT l_linenumber, l_discount, l_tax, l_returnflag FROM (" + SQL_LINE_GAPS + ")) " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(100.0 * (count(*) - count({c})) / count(*), 1) AS null_pct, count(DISTINCT {c}) AS "unique",
    {f'round(avg({c}), 2)' if n else 'NULL::DOUBLE'} AS mean, {f'round(stddev_pop({c}), 2)' if n else 'NULL::DOUBLE'} AS std,
    {f'round(min({c}), 2)::DOUBLE' if n else 'NULL::DOUBLE'} AS "min", {f'round(max({c}), 2)::DOUBLE' if n else 'NULL::DOUBLE'} AS "max" FROM src"""
    for c, n in [("l_linenumber", 1), ("l_discount", 1), ("l_tax", 1), ("l_returnflag", 0)]))
def preview_stats(spark, folder):
    return P.preview_stats(line_gaps(spark, folder).select("l_linenumber", "l_discount", "l_tax", "l_returnflag"))


@query("table_health", f"""
WITH src AS ({SQL_LINE_GAPS}), g AS (
  SELECT {' + '.join(f'({c} IS NULL)::BIGINT' for c in LINE_COLUMNS)} AS gaps FROM src)
SELECT count(*) AS rows, sum(gaps)::BIGINT AS null_cells, count(*) FILTER (gaps > 0) AS null_rows,
       floor(100.0 * (count(*) * 11 - sum(gaps)) / (count(*) * 11) + 0.5)::BIGINT AS health FROM g""")
def table_health(spark, folder):
    return P.table_health(line_gaps(spark, folder))


@query("row_search", """
SELECT p_partkey, p_name, p_brand, p_type FROM part
WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_brand), 'bolt') OR contains(lower(p_type), 'bolt')
   OR contains(p_partkey::VARCHAR, 'bolt')""")
def row_search(spark, folder):
    return P.search_rows(table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type"), " BOLT ")


@query("numeric_summary", _per_column(SQL_LINE_GAPS, LINE_NUMBERS, """
count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}::DOUBLE), 4) AS std, round(min({c})::DOUBLE, 4) AS "min",
round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50,
round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75, round(max({c})::DOUBLE, 4) AS "max" """))
def numeric_summary(spark, folder):
    return P.numeric_summary(line_gaps(spark, folder))


@query("target_distribution", """
SELECT round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std,
       min(l_extendedprice) AS "min", max(l_extendedprice) AS "max" FROM lineitem""")
def target_distribution(spark, folder):
    return P.target_distribution(table(spark, folder, "lineitem"), "l_extendedprice")


@query("top_correlations", "SELECT * FROM (" + _per_column(
    SQL_LINE_TOTAL, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    "round(corr({c}::DOUBLE, total), 4) AS correlation") + ') ORDER BY abs(correlation) DESC, "column" LIMIT 10')
def top_correlations(spark, folder):
    return P.top_correlations(line_total(spark, folder), "total")


@query("class_counts", f"""
SELECT n_name AS label, count(*) AS n FROM ({SQL_ORDER_FACTS}) GROUP BY 1 ORDER BY n DESC, label LIMIT 20""")
def class_counts(spark, folder):
    return P.class_counts(order_facts(spark, folder), "n_name")


@query("missing_per_column", _per_column(SQL_LINE_GAPS, LINE_COLUMNS, "count(*) - count({c}) AS missing"))
def missing_per_column(spark, folder):
    return P.missing_per_column(line_gaps(spark, folder))


def _detect(name: str, source: str, rule: str) -> str:
    return f"""
SELECT '{name}' AS target, {rule} AS problem_type, u AS "unique", n AS rows, lim AS class_limit FROM (
  SELECT u, n, least(greatest(15, floor(0.02 * n)), 30)::BIGINT AS lim
  FROM (SELECT count(DISTINCT {name}) AS u, count({name}) AS n FROM ({source})))"""


INTEGER_RULE = "CASE WHEN u > lim THEN 'regression' ELSE 'classification' END"


@query("detect_problem", " UNION ALL ".join([
    _detect("l_linestatus", SQL_LINE_GAPS, "'classification'"), _detect("l_discount", SQL_LINE_GAPS, "'regression'"),
    _detect("l_linenumber", SQL_LINE_GAPS, INTEGER_RULE), _detect("l_suppkey", SQL_LINE_GAPS, INTEGER_RULE)]))
def detect_problem(spark, folder):
    lines = line_gaps(spark, folder)
    one, *rest = [K.detect_problem(lines, c) for c in ("l_linestatus", "l_discount", "l_linenumber", "l_suppkey")]
    for more in rest:
        one = one.unionByName(more)
    return one


@query("override_rule", """
WITH s AS (SELECT count(DISTINCT l_linenumber) AS u1, count(l_linenumber) AS n1, count(DISTINCT l_partkey) AS u2,
                  count(l_partkey) AS n2, count(DISTINCT l_linestatus) AS u3, count(l_linestatus) AS n3 FROM lineitem)
SELECT 'l_linenumber' AS target, 'classification' AS proposed, u1 AS "unique", n1 AS rows, u1 <= 100 AND u1 <= 0.5 * n1 AS accepted FROM s
UNION ALL SELECT 'l_partkey', 'classification', u2, n2, u2 <= 100 AND u2 <= 0.5 * n2 FROM s
UNION ALL SELECT 'l_linestatus', 'regression', u3, n3, false FROM s""")
def override_rule(spark, folder):
    lines = table(spark, folder, "lineitem")
    asked = [("l_linenumber", "classification"), ("l_partkey", "classification"), ("l_linestatus", "regression")]
    one, *rest = [K.accepts_override(lines, c, p).drop("reason") for c, p in asked]
    for more in rest:
        one = one.unionByName(more)
    return one


@query("imbalance_plan", f"""
WITH c AS (SELECT quality AS label, count(*) AS n FROM ({SQL_LABELLED}) GROUP BY 1),
s AS (SELECT max(n) AS most, min(n) AS least, sum(n) AS rows, count(*) AS classes, arg_min(label, n) AS minority_class FROM c)
SELECT true AS applies, most / least > 1.5 AS detected, round(most / least, 2) AS ratio, minority_class,
       round(least / rows, 4) AS minority_share,
       CASE WHEN most / least > 1.5 THEN 'balanced_class_weights' END AS strategy,
       CASE WHEN most / least > 1.5 THEN 'f1_macro' ELSE 'accuracy' END AS selection_metric FROM s""")
def imbalance_plan(spark, folder):
    return K.assess_imbalance(labelled_documents(spark, folder), "quality")
