"""Leakage: single-feature scores, rank correlation, formulas."""

from pyspark.sql import functions as F

from tablewright.operators import audit as A
from tablewright.operators import leakage as L
from tablewright.plans.base import (
    LINE_KEY, SQL_LINE_NET, SQL_LINE_TOTAL, line_net, line_total, query, sql_fold,
)

FOLD = sql_fold(0, LINE_KEY, 3)
QUARTERS = "[" + ", ".join(f"{i / 16}" for i in range(17)) + "]"


def _quantile_bin(c: str) -> str:
    return f"""len(list_filter(e_{c}, lambda e: e < {c} AND e > lo_{c} AND e < hi_{c}))::VARCHAR"""


def _edges(columns) -> str:
    return ", ".join(
        f"list_distinct(quantile_cont({c}::DOUBLE, {QUARTERS})) AS e_{c}, min({c}) AS lo_{c}, max({c}) AS hi_{c}, count(DISTINCT {c}) AS d_{c}" for c in columns)


def _cells(source: str, y: str, by_quantile: list[str], by_value: list[str]) -> str:
    """Common table expressions: ``long(column, bin, fold, y)`` for every row and feature."""
    parts = [f"SELECT '{c}' AS c, CASE WHEN {c} IS NULL THEN '__missing__' WHEN d_{c} <= 16 THEN {c}::VARCHAR ELSE {_quantile_bin(c)} END AS bin, fold, y FROM src, edges"
             for c in by_quantile]
    for c in by_value:
        parts.append(f"""SELECT '{c}', CASE WHEN {c} IS NULL THEN '__missing__'
            WHEN {c}::VARCHAR IN (SELECT v FROM (SELECT {c}::VARCHAR AS v FROM src WHERE {c} IS NOT NULL GROUP BY 1
                                  ORDER BY count(*) DESC, v LIMIT 50)) THEN {c}::VARCHAR ELSE '__other__' END, fold, y FROM src""")
    edges = f"edges AS (SELECT {_edges(by_quantile)} FROM src)," if by_quantile else ""
    return f"WITH src AS (SELECT *, {FOLD} AS fold, {y} AS y FROM ({source})), {edges} long AS ({' UNION ALL '.join(parts)})"


# All columns but the target: those binned by quantile, and those by value.
CLASS_FEATURES = (["total", "l_quantity", "l_extendedprice", "l_suppkey", "l_orderkey", "l_partkey"],
                  ["l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"])


def _class_scores(source, y, by_quantile, by_value):
    return _cells(source, y, by_quantile, by_value) + """,
cells AS (SELECT c, bin, fold, y, count(*) AS n FROM long GROUP BY ALL),
folds AS (SELECT unnest([0, 1, 2]) AS fold),
dense AS (SELECT t.c, t.bin, t.y, f.fold, coalesce(o.n, 0) AS own, t.n - coalesce(o.n, 0) AS train
          FROM (SELECT c, bin, y, sum(n) AS n FROM cells GROUP BY ALL) t CROSS JOIN folds f
          LEFT JOIN cells o ON o.c = t.c AND o.bin = t.bin AND o.y = t.y AND o.fold = f.fold),
guess AS (SELECT c, bin, fold, sum(train) AS seen, first(y ORDER BY train DESC, y) AS y FROM dense GROUP BY ALL),
usual AS (SELECT c, fold, first(y ORDER BY n DESC, y) AS y FROM (SELECT c, fold, y, sum(train) AS n FROM dense GROUP BY ALL) GROUP BY ALL),
scores AS (SELECT d.c, sum(CASE WHEN d.y = CASE WHEN g.seen > 0 THEN g.y ELSE u.y END THEN d.own ELSE 0 END) / sum(d.own) AS score,
                  sum(d.own)::BIGINT AS rows
           FROM dense d JOIN guess g USING (c, bin, fold) JOIN usual u ON u.c = d.c AND u.fold = d.fold GROUP BY d.c)"""


@query("feature_scores_class", _class_scores(SQL_LINE_TOTAL, "late", *CLASS_FEATURES)
       + ' SELECT c AS "column", rows, round(score, 6) AS score FROM scores')
def feature_scores_class(spark, folder):
    features = CLASS_FEATURES[0] + CLASS_FEATURES[1]
    scores = L.class_scores(line_total(spark, folder), "late", features, LINE_KEY)
    return scores.select("column", "rows", F.round("score", 6).alias("score"))


VALUE_FEATURES = (["net", "l_quantity", "l_partkey", "l_suppkey", "l_orderkey"],
                  ["l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"])


def _value_scores(source, y, by_quantile, by_value):
    return _cells(source, y, by_quantile, by_value) + """,
cells AS (SELECT c, bin, fold, count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM long GROUP BY ALL),
fit AS (SELECT *, sum(n) OVER (PARTITION BY c, bin) - n AS tn, sum(s) OVER (PARTITION BY c, bin) - s AS ts,
               sum(n) OVER (PARTITION BY c) - sum(n) OVER (PARTITION BY c, fold) AS rn,
               sum(s) OVER (PARTITION BY c) - sum(s) OVER (PARTITION BY c, fold) AS rs FROM cells),
err AS (SELECT *, CASE WHEN tn > 0 THEN ts / tn ELSE rs / rn END AS g FROM fit),
scores AS (SELECT c, sum(n)::BIGINT AS rows,
                  1 - sum(ss - 2 * g * s + n * g * g) / (sum(ss) - sum(s) * sum(s) / sum(n)) AS score FROM err GROUP BY c)"""


@query("feature_scores_reg", _value_scores(SQL_LINE_NET, "l_extendedprice", *VALUE_FEATURES)
       + ' SELECT c AS "column", rows, round(score, 6) AS score FROM scores')
def feature_scores_reg(spark, folder):
    features = VALUE_FEATURES[0] + VALUE_FEATURES[1]
    scores = L.regression_scores(line_net(spark, folder), "l_extendedprice", features, LINE_KEY)
    return scores.select("column", "rows", F.round("score", 6).alias("score"))


@query("quantile_bins", f"""
WITH e AS (SELECT {_edges(['l_extendedprice'])} FROM lineitem)
SELECT bin, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high
FROM (SELECT l_extendedprice, {_quantile_bin('l_extendedprice')}::BIGINT AS bin FROM lineitem, e) GROUP BY bin""")
def quantile_bins(spark, folder):
    lines = line_net(spark, folder)
    edges = L.quantile_bins(lines, ["l_extendedprice"])["l_extendedprice"]
    spot = L.bin_index(F.col("l_extendedprice"), edges).cast("bigint")
    return lines.groupBy(spot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query("category_bins", """
WITH t AS (SELECT source AS v, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, v LIMIT 50)
SELECT CASE WHEN source IS NULL THEN '__missing__' WHEN source IN (SELECT v FROM t) THEN source ELSE '__other__' END AS bin,
       count(*) AS n FROM documents GROUP BY 1""")
def category_bins(spark, folder):
    from tablewright.plans.base import table
    docs = table(spark, folder, "documents")
    return docs.groupBy(L.binned(docs, ["source"])["source"].alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _ranks(source, target, features):
    parts = " UNION ALL ".join(f"""
SELECT '{c}' AS c, corr(rx, ry) AS r FROM (
  SELECT rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS rx,
         rank() OVER (ORDER BY {target}) + (count(*) OVER (PARTITION BY {target}) - 1) / 2 AS ry
  FROM src0 WHERE {c} IS NOT NULL AND {target} IS NOT NULL)""" for c in features)
    return f"src0 AS ({source}), ranks AS (SELECT c, coalesce(r * r, 0) AS rank_r2 FROM ({parts}))"


RANKED = ["net", "l_quantity", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"]  # all numbers


@query("rank_correlation", "WITH " + _ranks(SQL_LINE_NET, "l_extendedprice", RANKED)
       + ' SELECT c AS "column", round(rank_r2, 6) AS rank_r2 FROM ranks')
def rank_correlation(spark, folder):
    ranks = L.rank_correlations(line_net(spark, folder), "l_extendedprice", RANKED)
    return ranks.select("column", F.round("rank_r2", 6).alias("rank_r2"))


@query("leakage_suspects", _class_scores(SQL_LINE_TOTAL, "late", *CLASS_FEATURES) + """
SELECT c AS "column", round(score, 4) AS score FROM scores WHERE score >= 0.98
  AND (SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM src GROUP BY late)) < 0.98""")
def leakage_suspects(spark, folder):
    return L.leakage_suspects(line_total(spark, folder), "late", "classification", LINE_KEY)


@query("leakage_suspects_reg", _value_scores(SQL_LINE_NET, "l_extendedprice", *VALUE_FEATURES) + ", "
       + _ranks(SQL_LINE_NET, "l_extendedprice", RANKED) + """
SELECT c AS "column", round(greatest(score, rank_r2), 4) AS score FROM scores LEFT JOIN ranks USING (c)
WHERE greatest(score, rank_r2) >= 0.98""")
def leakage_suspects_reg(spark, folder):
    return L.leakage_suspects(line_net(spark, folder), "l_extendedprice", "regression", LINE_KEY)


@query("held_out_line", f"""
WITH src AS (SELECT total AS y, l_discount AS x, {FOLD} AS fold FROM ({SQL_LINE_TOTAL})),
fits AS (SELECT f.fold, regr_slope(y, x) AS w, regr_intercept(y, x) AS b
         FROM src JOIN (SELECT unnest([0, 1, 2]) AS fold) f ON src.fold <> f.fold GROUP BY f.fold)
SELECT round(1 - sum((y - w * x - b) * (y - w * x - b)) / (var_pop(y) * count(*)), 6) AS r2 FROM src JOIN fits USING (fold)""")
def held_out_line(spark, folder):
    r2 = L.held_out_r2(line_total(spark, folder), "total", ["l_discount"], LINE_KEY)
    return spark.createDataFrame([(round(r2, 6),)], "r2 double")


@query("formula_target", f"""
WITH src AS ({SQL_LINE_TOTAL})
SELECT c AS target FROM (SELECT 'total' AS c, count(DISTINCT total) AS u FROM src
  UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity) FROM src UNION ALL SELECT 'l_tax', count(DISTINCT l_tax) FROM src)
WHERE u >= 20 ORDER BY u DESC, c LIMIT 1""")
def formula_target(spark, folder):
    name = L.formula_target(line_total(spark, folder), "late", "classification", ["l_tax", "l_quantity", "total", "l_returnflag"])
    return spark.createDataFrame([(name,)], "target string")


def _formula_table(spark, formula):
    rows = [(formula.target, c, w, formula.r2, formula.rows, formula.constant) for c, w in formula.weights.items()] if formula else []
    return spark.createDataFrame(
        rows, "target string, `column` string, weight double, r2 double, rows bigint, constant double")


# The planted formula is exact, so what must be found is known.
@query("formula_leak", f"""
SELECT 'total' AS target, c AS "column", w AS weight, 1.0::DOUBLE AS r2, n AS rows, 0.0::DOUBLE AS constant
FROM (VALUES ('l_quantity', 1.0::DOUBLE), ('l_discount', 500.0::DOUBLE), ('l_tax', 500.0::DOUBLE)) v(c, w),
     (SELECT count(*) AS n FROM ({SQL_LINE_TOTAL}))""")
def formula_leak(spark, folder):
    found = L.formula_leak(line_total(spark, folder), "total", None, LINE_KEY)
    table_ = _formula_table(spark, found)
    return table_.withColumn("constant", F.abs("constant"))


@query("critical_findings", _class_scores(SQL_LINE_TOTAL, "late", *CLASS_FEATURES) + """
SELECT 'leakage_suspect' AS "check", c AS "column", round(score, 4) AS value FROM scores WHERE score >= 0.98
UNION ALL SELECT 'leakage_formula', NULL, 1.0::DOUBLE FROM scores WHERE c = 'total' AND score >= 0.98""")
def critical_findings(spark, folder):
    """The audit with its leak checks: the column that decides the class, and the planted sum behind that column."""
    found = A.audit(line_total(spark, folder), "late", "classification", LINE_KEY)
    return found.filter("severity = 'critical'").select("check", "column", "value")


@query("formula_in_kept", f"""
SELECT 'total' AS target, c AS "column", w AS weight, 1.0::DOUBLE AS r2, n AS rows, 0.0::DOUBLE AS constant
FROM (VALUES ('l_quantity', 1.0::DOUBLE), ('l_discount', 500.0::DOUBLE), ('l_tax', 500.0::DOUBLE)) v(c, w),
     (SELECT count(*) AS n FROM ({SQL_LINE_TOTAL}))""")
def formula_in_kept(spark, folder):
    lines = line_total(spark, folder)
    found = L.formula_in_kept(lines, "late", "classification", ["l_orderkey", "l_partkey"], ["total"], LINE_KEY)
    return _formula_table(spark, found).withColumn("constant", F.abs("constant"))
