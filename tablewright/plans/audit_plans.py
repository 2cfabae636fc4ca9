"""Data-quality checks."""

from pyspark.sql import functions as F

from tablewright.operators import audit as A
from tablewright.operators.profile import profile
from tablewright.plans.base import (
    SQL_LABELLED, SQL_LINE_GAPS, SQL_ORDER_FACTS, SQL_ORDER_TEXT, labelled_documents, line_gaps, order_facts,
    order_text, query, table,
)
from tablewright.session import settled

SHOWN = ["check", "severity", "column", "value"]
LINE = 'SELECT \'{check}\' AS "check", \'{severity}\' AS severity, {column} AS "column", {value} AS value'


def say(check, severity, column, value, tail):
    column = "NULL::VARCHAR" if column is None else f"'{column}'"
    return LINE.format(check=check, severity=severity, column=column, value=f"({value})::DOUBLE") + " " + tail


@query("target_missing", say("target_missing", "warning", "l_tax", "round(100.0 * m / n, 2)",
       f"FROM (SELECT count(*) AS n, count(*) - count(l_tax) AS m FROM ({SQL_LINE_GAPS})) WHERE m > 0"))
def target_missing(spark, folder):
    return A.target_missing(line_gaps(spark, folder), "l_tax").select(*SHOWN)


@query("class_imbalance", say("class_imbalance", "warning", "quality", "round(r, 2)",
       f"FROM (SELECT max(n) / min(n) AS r FROM (SELECT count(*) AS n FROM ({SQL_LABELLED}) GROUP BY quality)) WHERE r > 1.5"))
def class_imbalance(spark, folder):
    return A.class_imbalance(labelled_documents(spark, folder), "quality").select(*SHOWN)


@query("rare_classes", f"""
SELECT 'rare_classes' AS "check", 'warning' AS severity, 'c_name' AS "column", n::DOUBLE AS value,
       'class ' || c_name || ' has ' || n || ' rows' AS detail
FROM (SELECT c_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) WHERE n < 10""")
def rare_classes(spark, folder):
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")
    named = orders.select("o_custkey").join(customers.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return A.rare_classes(named, "c_name")


@query("target_skew", say("target_skew", "info", "n_chars", "s",
       "FROM (SELECT round(skewness(n_chars), 2) AS s FROM documents) WHERE abs(s) > 2"))
def target_skew(spark, folder):
    return A.target_skew(table(spark, folder, "documents"), "n_chars").select(*SHOWN)


@query("duplicate_rows", say("duplicate_rows", "warning", None, "d",
       "FROM (SELECT sum(n) - count(*) AS d FROM (SELECT count(*) AS n FROM (SELECT text, lang FROM documents) GROUP BY text, lang)) WHERE d > 0"))
def duplicate_rows(spark, folder):
    return A.duplicate_rows(table(spark, folder, "documents").select("text", "lang")).select(*SHOWN)


@query("conflicting_rows", say("conflicting_rows", "info", None, "c", """
FROM (SELECT sum(v) - count(*) AS c FROM (
  SELECT count(*) AS v FROM (SELECT DISTINCT l_suppkey, l_linenumber, l_discount, l_returnflag FROM lineitem)
  GROUP BY l_suppkey, l_linenumber, l_discount)) WHERE c > 0"""))
def conflicting_rows(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_suppkey", "l_linenumber", "l_discount", "l_returnflag")
    return A.conflicting_rows(lines, "l_returnflag").select(*SHOWN)


def _distinct(source, columns):
    return f"WITH src AS ({source}), s AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS c, count(*) AS n, count(*) - count({c}) AS m, count(DISTINCT {c}) AS u FROM src" for c in columns) + ") "


@query("constant_columns", _distinct("SELECT o_orderkey, o_orderstatus, 'x' AS fixed, NULL::VARCHAR AS void FROM orders",
                                     ["o_orderkey", "o_orderstatus", "fixed", "void"])
       + "SELECT 'constant_column' AS \"check\", 'info' AS severity, c AS \"column\", u::DOUBLE AS value FROM s WHERE u <= 1")
def constant_columns(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", F.lit("x").alias("fixed"), F.lit(None).cast("string").alias("void"))
    return A.constant_columns(profile(rows)).select(*SHOWN)


@query("high_missing", _distinct(SQL_LINE_GAPS, ["l_quantity", "l_discount", "l_tax"])
       + """SELECT 'high_missing' AS "check", 'info' AS severity, c AS "column", round(100.0 * m / n, 2) AS value
FROM s WHERE u > 1 AND m > 0.5 * n""")
def high_missing(spark, folder):
    return A.high_missing(profile(line_gaps(spark, folder), ["l_quantity", "l_discount", "l_tax"])).select(*SHOWN)


@query("row_identifier", """
WITH src AS (SELECT o_orderkey, o_custkey, -2 * o_orderkey AS falling, o_orderkey // 2 AS repeated FROM orders),
d AS (SELECT o_orderkey - lag(o_orderkey) OVER w AS a, o_custkey - lag(o_custkey) OVER w AS b,
             falling - lag(falling) OVER w AS c, repeated - lag(repeated) OVER w AS e FROM src WINDOW w AS (ORDER BY o_orderkey)),
s AS (SELECT 'o_orderkey' AS n, min(a) AS lo, max(a) AS hi FROM d UNION ALL SELECT 'o_custkey', min(b), max(b) FROM d
      UNION ALL SELECT 'falling', min(c), max(c) FROM d UNION ALL SELECT 'repeated', min(e), max(e) FROM d)
SELECT 'row_identifier' AS "check", 'warning' AS severity, n AS "column", 1.0::DOUBLE AS value FROM s WHERE lo > 0 OR hi < 0""")
def row_identifier(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", (-2 * F.col("o_orderkey")).alias("falling"),
        F.floor(F.col("o_orderkey") / 2).cast("bigint").alias("repeated"))
    return A.row_identifier(rows, "o_orderkey", bucket=4096).select(*SHOWN)


@query("temporal_columns", """
SELECT 'temporal_column' AS "check", 'warning' AS severity, 'l_shipdate' AS "column", count(l_shipdate)::DOUBLE AS value
FROM lineitem""")
def temporal_columns(spark, folder):
    return A.temporal_columns(table(spark, folder, "lineitem")).select(*SHOWN)


@query("identifier_like", _distinct("SELECT text, lang, source FROM documents", ["text", "lang", "source"])
       + """SELECT 'identifier_like' AS "check", 'info' AS severity, c AS "column", u::DOUBLE AS value
FROM s WHERE u > 1 AND u >= 0.9 * (n - m)""")
def identifier_like(spark, folder):
    docs = table(spark, folder, "documents").select("text", "lang", "source")
    return A.identifier_like(profile(docs), ["text", "lang", "source"], share=0.9).select(*SHOWN)


NUMBER = r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*"
DATES = "['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%Y/%m/%d', '%m/%d/%Y']"
TEXT_COLUMNS = ["amount", "day_text", "status_text", "priority"]


@query("numeric_as_text", f"WITH src AS ({SQL_ORDER_TEXT}) " + " UNION ALL ".join(
    f"""SELECT 'numeric_stored_as_text' AS "check", 'warning' AS severity, '{c}' AS "column", round(100.0 * s, 2) AS value FROM (
    SELECT avg(regexp_full_match(regexp_replace({c}, '[,\\s$€£%]', '', 'g'), '{NUMBER}')::INT) AS s FROM src) WHERE s >= 0.9"""
    for c in TEXT_COLUMNS))
def numeric_as_text(spark, folder):
    return A.numeric_stored_as_text(A.text_patterns(order_text(spark, folder), TEXT_COLUMNS)).select(*SHOWN)


@query("date_as_text", f"WITH src AS ({SQL_ORDER_TEXT}) " + " UNION ALL ".join(
    f"""SELECT 'temporal_column' AS "check", 'warning' AS severity, '{c}' AS "column", round(100.0 * s, 2) AS value FROM (
    SELECT avg((try_strptime({c}, {DATES}) IS NOT NULL)::INT) AS s FROM src WHERE NOT regexp_full_match({c}, '{NUMBER}')) WHERE s >= 0.9"""
    for c in TEXT_COLUMNS))
def date_as_text(spark, folder):
    return A.dates_stored_as_text(A.text_patterns(order_text(spark, folder), TEXT_COLUMNS)).select(*SHOWN)


@query("findings_report", f"""
WITH src AS (SELECT l_partkey, l_suppkey, l_linenumber, l_discount, l_tax, l_returnflag, l_shipdate FROM ({SQL_LINE_GAPS})),
t AS (SELECT count(*) AS n, count(*) - count(l_returnflag) AS m FROM src),
dup AS (SELECT sum(n) AS n, sum(n) - count(*) AS d FROM (SELECT count(*) AS n FROM src GROUP BY l_partkey, l_suppkey, l_linenumber, l_discount, l_tax, l_returnflag, l_shipdate)),
conf AS (SELECT sum(v) - count(*) AS c FROM (SELECT count(*) AS v FROM (SELECT DISTINCT * FROM src)
         GROUP BY l_partkey, l_suppkey, l_linenumber, l_discount, l_tax, l_shipdate)),
cls AS (SELECT max(n) / min(n) AS r, min(n) AS least FROM (SELECT count(*) AS n FROM src GROUP BY l_returnflag)),
gaps AS (SELECT 'l_discount' AS c, count(*) AS n, count(*) - count(l_discount) AS m FROM src
         UNION ALL SELECT 'l_tax', count(*), count(*) - count(l_tax) FROM src)
SELECT 'duplicate_rows' AS "check", 'warning' AS severity, NULL::VARCHAR AS "column", d::DOUBLE AS value FROM dup WHERE d > 0
UNION ALL SELECT 'conflicting_rows', 'info', NULL, c::DOUBLE FROM conf WHERE c > 0
UNION ALL SELECT 'class_imbalance', 'warning', 'l_returnflag', round(r, 2) FROM cls WHERE r > 1.5
UNION ALL SELECT 'high_missing', 'info', c, round(100.0 * m / n, 2) FROM gaps WHERE m > 0.5 * n
UNION ALL SELECT 'temporal_column', 'warning', 'l_shipdate', n::DOUBLE FROM t""")
def findings_report(spark, folder):
    lines = line_gaps(spark, folder).select(
        "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    return A.audit(lines, "l_returnflag", "classification", leaks=False).select(*SHOWN)


@query("severity_counts", f"""
WITH src AS ({SQL_ORDER_FACTS})
SELECT 'info' AS severity, count(*) AS n FROM (
  SELECT 1 FROM (SELECT count(DISTINCT n_name) AS a, count(DISTINCT o_orderkey) AS b, count(*) AS n FROM src) WHERE a <= 1 OR b <= 1
  UNION ALL SELECT 1 FROM (SELECT count(DISTINCT code) AS u, count(*) AS n FROM (SELECT 'k' || o_orderkey AS code FROM src)) WHERE u >= 0.95 * n)
GROUP BY 1""")
def severity_counts(spark, folder):
    facts = order_facts(spark, folder).select(
        "o_orderkey", "n_name", F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("code"))
    stats = settled(profile(facts))  # one row per column
    found = A.report([A.constant_columns(stats), A.high_missing(stats), A.identifier_like(stats, ["n_name", "code"])])
    return A.severity_counts(found)


