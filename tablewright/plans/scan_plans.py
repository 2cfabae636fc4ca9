"""Scans, normalisation and previews."""

from pyspark.sql import functions as F

from tablewright.functions import values as V
from tablewright.operators import scoring
from tablewright.plans.base import SQL_LINE_GAPS, line_gaps, query, table
from tablewright.sources import normalize as N
from tablewright.sources import readers


@query("head_rows", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20")
def head_rows(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return scoring.first_rows(rows, ["o_orderkey"], 20)


@query("pruned_scan", "SELECT l_returnflag, l_quantity FROM lineitem")
def pruned_scan(spark, folder):
    return readers.load_columns(spark, f"{folder}/lineitem.parquet", ["l_returnflag", "l_quantity"])


MISSING = ", ".join("'" + t + "'" for t in V.MISSING_TOKENS)


@query("missing_tokens", f"""
SELECT o_orderkey, CASE WHEN word IN ({MISSING}) THEN NULL ELSE word END AS word
FROM (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'NA' WHEN 1 THEN 'n/a' WHEN 2 THEN '' WHEN 3 THEN ' NA'
                              WHEN 4 THEN 'none' ELSE o_orderpriority END AS word FROM orders)""")
def missing_tokens(spark, folder):
    at = F.col("o_orderkey") % 7
    word = (F.when(at == 0, "NA").when(at == 1, "n/a").when(at == 2, "").when(at == 3, " NA").when(at == 4, "none")
            .otherwise(F.col("o_orderpriority")))
    return N.blank_tokens(table(spark, folder, "orders").select("o_orderkey", word.alias("word")))


@query("flatten_json", """
SELECT event_id, (props ->> '$.k')::BIGINT AS "props.k" FROM events""")
def flatten_json(spark, folder):
    parsed = F.from_json("props", "k bigint").alias("props")
    return N.flatten(table(spark, folder, "events").select("event_id", parsed))


@query("drop_empty", """
SELECT l_orderkey, l_discount, l_tax FROM (
  SELECT CASE WHEN l_discount IS NOT NULL OR l_tax IS NOT NULL THEN l_orderkey END AS l_orderkey, l_discount, l_tax
  FROM (""" + SQL_LINE_GAPS + """)) WHERE NOT (l_orderkey IS NULL AND l_discount IS NULL AND l_tax IS NULL)""")
def drop_empty(spark, folder):
    either = F.col("l_discount").isNotNull() | F.col("l_tax").isNotNull()
    gaps = line_gaps(spark, folder).select(
        F.when(either, F.col("l_orderkey")).alias("l_orderkey"), F.lit(None).cast("string").alias("void"),
        "l_discount", "l_tax")
    return N.normalize(gaps).table


@query("name_repair", """
SELECT o_orderkey AS a, o_orderstatus AS a_2, o_custkey AS a_3, o_totalprice AS column_4 FROM orders""")
def name_repair(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice")
    names, _ = N.repair_names([" a ", "a_2", "a", ""])
    return rows.toDF(*names)


@query("ingest_counts", """
SELECT 'rows' AS step, count(*)::VARCHAR AS detail FROM lineitem
UNION ALL SELECT 'columns', '11' UNION ALL SELECT 'empty rows', '0'""")
def ingest_counts(spark, folder):
    done = N.normalize(table(spark, folder, "lineitem"))
    counts = done.report.filter("step IN ('rows', 'columns')").select("step", "detail")
    blank = done.report.agg(F.count_if(F.col("detail").contains("empty row")).cast("string").alias("detail"))
    return counts.unionByName(blank.select(F.lit("empty rows").alias("step"), "detail"))


@query("storable_values", """
SELECT vec_id, len(embedding)::BIGINT AS width, label::DOUBLE AS label FROM embeddings""")
def storable_values(spark, folder):
    rows = table(spark, folder, "embeddings").withColumn("label", F.col("label").cast("decimal(10,2)"))
    kept, _ = N.storable(rows)
    width = F.size(F.from_json("embedding", "array<double>")).cast("bigint")
    return kept.select("vec_id", width.alias("width"), "label")


@query("input_schema", """
WITH f AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1)
SELECT 'o_custkey' AS "column", 'bigint' AS dtype, o_custkey::VARCHAR AS example FROM f
UNION ALL SELECT 'o_orderstatus', 'string', o_orderstatus FROM f
UNION ALL SELECT 'o_orderpriority', 'string', o_orderpriority FROM f""")
def input_schema(spark, folder):
    orders = table(spark, folder, "orders")
    return scoring.input_schema(orders, ["o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"], ["o_orderkey"],
                                "o_totalprice")


@query("form_value_types", r"""
SELECT o_orderkey, trim(v) = '' AS missing,
       CASE WHEN regexp_full_match(v, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*') THEN trim(v)::DOUBLE END AS number,
       CASE WHEN trim(v) <> '' AND NOT regexp_full_match(v, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*') THEN v END AS text
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' ' || o_custkey WHEN 1 THEN '' WHEN 2 THEN o_custkey || 'd'
                              ELSE o_orderpriority END AS v FROM orders)""")
def form_value_types(spark, folder):
    at, number = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    value = (F.when(at == 0, F.concat(F.lit(" "), number)).when(at == 1, "").when(at == 2, F.concat(number, F.lit("d")))
             .otherwise(F.col("o_orderpriority")))
    typed = table(spark, folder, "orders").select("o_orderkey", scoring.typed_value(value).alias("t"))
    return typed.select("o_orderkey", "t.*")


