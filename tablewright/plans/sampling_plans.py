"""Samples, splits, folds and class weights."""

from pyspark.sql import functions as F

from tablewright.operators import sampling as S
from tablewright.plans.base import LINE_KEY, SQL_LABELLED, SQL_LINE_TOTAL, labelled_documents, line_total, query, sql_hash, table

KEYS = ", ".join(LINE_KEY)
SQL_CHECK = "count(*) AS n, sum(l_orderkey)::BIGINT AS orders, sum(l_partkey)::BIGINT AS parts"


def check():
    return [F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("orders"), F.sum("l_partkey").alias("parts")]


def _quotas(source: str, label: str, total: str) -> str:
    """Common table expressions: ``quota(label, k)`` by largest remainder, ties to the smaller label."""
    return f"""src AS ({source}), sizes AS (SELECT {label} AS label, count(*) AS n FROM src GROUP BY 1),
whole AS (SELECT sum(n)::BIGINT AS n, ({total})::BIGINT AS want FROM sizes),
base AS (SELECT label, sizes.n * want // whole.n AS k, sizes.n * want % whole.n AS rest FROM sizes, whole),
quota AS (SELECT label, k + (row_number() OVER (ORDER BY rest DESC, label)
          <= (SELECT want FROM whole) - (SELECT sum(k) FROM base))::BIGINT AS k FROM base)"""


def _ranked(label: str, seed: int) -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {sql_hash(seed, LINE_KEY)}, {KEYS}) AS r FROM src)"""


@query("working_set", f"WITH {_quotas(SQL_LINE_TOTAL, 'late', '3000')}, {_ranked('late', 42)}"
       + f" SELECT late, {SQL_CHECK} FROM ranked JOIN quota ON late = label WHERE r <= k GROUP BY late")
def working_set(spark, folder):
    rows, _ = S.working_set(line_total(spark, folder), "late", LINE_KEY, n=3000)
    return rows.groupBy("late").agg(*check())


@query("uniform_sample", f"SELECT {KEYS} FROM lineitem ORDER BY {sql_hash(42, LINE_KEY)}, {KEYS} LIMIT 5000")
def uniform_sample(spark, folder):
    return S.uniform_sample(table(spark, folder, "lineitem"), 5000, LINE_KEY).select(*LINE_KEY)


@query("train_test_split", f"WITH {_quotas('SELECT * FROM lineitem', 'l_returnflag', 'ceil(sum(n) * 0.2::DOUBLE)')}, {_ranked('l_returnflag', 42)}"
       + f" SELECT l_returnflag, r <= k AS is_test, {SQL_CHECK} FROM ranked JOIN quota ON l_returnflag = label GROUP BY ALL")
def train_test_split(spark, folder):
    return S.train_test_split(table(spark, folder, "lineitem"), "l_returnflag", LINE_KEY).groupBy("l_returnflag", "is_test").agg(*check())


@query("early_stopping_slice", f"WITH {_quotas('SELECT * FROM lineitem', 'l_returnflag', 'ceil(sum(n) * 0.1::DOUBLE)')}, {_ranked('l_returnflag', 44)}"
       + f" SELECT l_returnflag, r <= k AS is_validation, {SQL_CHECK} FROM ranked JOIN quota ON l_returnflag = label GROUP BY ALL")
def early_stopping_slice(spark, folder):
    cut = S.early_stopping_slice(table(spark, folder, "lineitem"), "l_returnflag", LINE_KEY)
    return cut.groupBy("l_returnflag", "is_validation").agg(*check())


@query("fold_sizes", f"""
WITH src AS (SELECT *, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem), {_ranked('l_returnflag', 43)}
SELECT l_returnflag, ((r > n // 5)::INT + (r > n * 2 // 5)::INT + (r > n * 3 // 5)::INT + (r > n * 4 // 5)::INT) AS fold,
       {SQL_CHECK} FROM ranked GROUP BY ALL""")
def fold_sizes(spark, folder):
    return S.with_folds(table(spark, folder, "lineitem"), "l_returnflag", LINE_KEY).groupBy("l_returnflag", "fold").agg(*check())


@query("fold_sizes_reg", f"""
WITH src AS (SELECT *, count(*) OVER () AS n, 0 AS every FROM lineitem), {_ranked('every', 43)}
SELECT ((r > n // 5)::INT + (r > n * 2 // 5)::INT + (r > n * 3 // 5)::INT + (r > n * 4 // 5)::INT) AS fold,
       {SQL_CHECK} FROM ranked GROUP BY ALL""")
def fold_sizes_reg(spark, folder):
    lines = table(spark, folder, "lineitem")
    return S.with_folds(lines, "l_extendedprice", LINE_KEY, classification=False).groupBy("fold").agg(*check())


DOC_FOLDS = f"""
SELECT *, ((r > n // 5)::INT + (r > n * 2 // 5)::INT + (r > n * 3 // 5)::INT + (r > n * 4 // 5)::INT) AS fold FROM (
  SELECT *, count(*) OVER (PARTITION BY quality) AS n,
         row_number() OVER (PARTITION BY quality ORDER BY {sql_hash(43, ['doc_id'])}) AS r FROM ({SQL_LABELLED}))"""


@query("class_weights", f"""
WITH f AS ({DOC_FOLDS}), t AS (SELECT k.fold, f.quality AS label, count(*) AS train_rows
  FROM f JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS fold) k ON f.fold <> k.fold GROUP BY ALL)
SELECT fold, label, train_rows,
       round(sum(train_rows) OVER (PARTITION BY fold) / (count(*) OVER (PARTITION BY fold) * train_rows), 6) AS weight FROM t""")
def class_weights(spark, folder):
    folds = S.with_folds(labelled_documents(spark, folder), "quality", ["doc_id"], folds=5)
    return S.class_weights(folds, "quality", 5)


@query("label_codes", """
SELECT o_orderpriority AS label, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code
FROM (SELECT DISTINCT o_orderpriority FROM orders)""")
def label_codes(spark, folder):
    return S.label_codes(table(spark, folder, "orders"), "o_orderpriority")


@query("class_size_guard", """
SELECT user_id::VARCHAR AS label, count(*) AS n FROM events GROUP BY 1 HAVING count(*) < 3""")
def class_size_guard(spark, folder):
    return S.check_class_sizes(table(spark, folder, "events"), "user_id")
