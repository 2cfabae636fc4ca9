"""Cleaning, derived columns, and feature engineering."""

from pyspark.sql import functions as F

from tablewright.functions import values as V
from tablewright.functions.formula import formula_column, range_column
from tablewright.operators import cleaning as C
from tablewright.operators import features as E
from tablewright.operators.plan_rules import judge_plan
from tablewright.plans.base import (
    SQL_LINE_GAPS, SQL_ORDER_FACTS, SQL_ORDER_TEXT, line_gaps, order_facts, order_text, query, table,
)


def types_of(df):
    return {f.name: f.dataType for f in df.schema.fields}


@query("missing_codes", f"""
SELECT l_linenumber, count(*) AS n, count(l_quantity) AS kept, sum(l_quantity)::BIGINT AS total
FROM (SELECT l_linenumber, CASE WHEN l_quantity <> -999 AND l_quantity <> 7 THEN l_quantity END AS l_quantity FROM ({SQL_LINE_GAPS}))
GROUP BY 1""")
def missing_codes(spark, folder):
    spec = C.CleaningSpec(missing_codes={"l_quantity": [-999, "7"]})
    return C.prepare(line_gaps(spark, folder), spec).groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.count("l_quantity").alias("kept"), F.sum("l_quantity").cast("bigint").alias("total"))


@query("code_labels", """
SELECT label, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM (
  SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN (o_custkey % 5)::BIGINT::VARCHAR
    WHEN 1 THEN (o_custkey % 5 + 0.5)::DOUBLE::VARCHAR ELSE trim(o_orderpriority) END AS label FROM orders) GROUP BY 1""")
def code_labels(spark, folder):
    at, code = F.col("o_orderkey") % 3, (F.col("o_custkey") % 5).cast("double")
    value = (F.when(at == 0, code.cast("string")).when(at == 1, (code + 0.5).cast("string"))
             .otherwise(F.concat(F.lit(" "), F.col("o_orderpriority"))))
    orders = table(spark, folder, "orders").withColumn("v", value)
    label = V.code_label(F.col("v"), orders.schema["v"].dataType)
    return orders.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


MIXED_DATES = """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d')
       WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE 'soon' END AS day FROM orders"""


def mixed_dates(spark, folder):
    at, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    day = (F.when(at == 0, F.date_format(d, "yyyy-MM-dd")).when(at == 1, F.date_format(d, "yyyy/MM/dd"))
           .when(at == 2, F.date_format(d, "MM/dd/yyyy")).otherwise("soon"))
    return table(spark, folder, "orders").select("o_orderkey", day.alias("day"))


@query("parse_dates", f"""
SELECT o_orderkey, strftime(try_strptime(day, ['%Y-%m-%d', '%Y/%m/%d', '%m/%d/%Y']), '%Y-%m-%d') AS parsed FROM ({MIXED_DATES})""")
def parse_dates(spark, folder):
    dates = mixed_dates(spark, folder)
    stamp = V.parse_timestamp(F.col("day"), dates.schema["day"].dataType)
    return dates.select("o_orderkey", F.date_format(stamp, "yyyy-MM-dd").alias("parsed"))


@query("date_parts", f"""
SELECT o_orderkey, year(t)::DOUBLE AS day__year, month(t)::DOUBLE AS day__month, day(t)::DOUBLE AS day__day,
       (isodow(t) - 1)::DOUBLE AS day__day_of_week, hour(t)::DOUBLE AS day__hour
FROM (SELECT o_orderkey, try_strptime(day, ['%Y-%m-%d', '%Y/%m/%d', '%m/%d/%Y']) AS t FROM ({MIXED_DATES}))""")
def date_parts(spark, folder):
    return C.prepare(mixed_dates(spark, folder), C.CleaningSpec(date_parts={"day": list(V.DATE_PARTS)}))


FORMULAS = {
    "unit": "l_extendedprice * (1 - l_discount) / (l_quantity - 7)",
    "returned": 'l_returnflag == "R" and l_quantity >= 30',
    "either": "l_tax > 0.05 or l_discount > 0.05",
    "logs": "log(l_discount) + log1p(l_tax)",
    "root": "sqrt(l_tax - 0.03)",
    "opposite": "not (l_tax > 0.02)",
    "power": "-abs(l_linenumber - 4) ** 2",
}
FORMULA_SQL = """
  CASE WHEN l_quantity <> 7 THEN l_extendedprice * (1 - l_discount) / (l_quantity - 7) END AS unit,
  CASE WHEN l_returnflag = 'R' AND l_quantity >= 30 THEN 1.0 ELSE 0.0 END::DOUBLE AS returned,
  CASE WHEN l_tax IS NULL OR l_discount IS NULL THEN NULL WHEN l_tax > 0.05::DOUBLE OR l_discount > 0.05::DOUBLE THEN 1.0 ELSE 0.0 END::DOUBLE AS either,
  CASE WHEN l_discount > 0 THEN ln(l_discount) + ln(1 + l_tax) END AS logs,
  CASE WHEN l_tax >= 0.03::DOUBLE THEN sqrt(l_tax - 0.03::DOUBLE) END AS root,
  CASE WHEN l_tax > 0.02::DOUBLE THEN 0.0 WHEN l_tax IS NOT NULL THEN 1.0 END::DOUBLE AS opposite,
  -((abs(l_linenumber - 4)) ** 2)::DOUBLE AS power"""


@query("formula_column", f"""
SELECT l_orderkey, l_partkey, unit, returned, either, round(logs, 6) AS logs, round(root, 6) AS root, opposite, power
FROM (SELECT l_orderkey, l_partkey, {FORMULA_SQL} FROM ({SQL_LINE_GAPS}))""")
def formula_columns_(spark, folder):
    lines = line_gaps(spark, folder)
    built = {n: formula_column(f, types_of(lines)) for n, f in FORMULAS.items()}
    rounded = {"logs": 6, "root": 6}
    return lines.select("l_orderkey", "l_partkey", *[
        (F.round(c, rounded[n]) if n in rounded else c).alias(n) for n, c in built.items()])


@query("range_column", f"""
SELECT CASE WHEN l_discount < 0.02::DOUBLE THEN 'low' WHEN l_discount < 0.07::DOUBLE THEN 'middle'
            WHEN l_discount IS NOT NULL THEN 'high' END AS band, count(*) AS n FROM ({SQL_LINE_GAPS}) GROUP BY 1""")
def range_column_(spark, folder):
    lines = line_gaps(spark, folder)
    band = range_column(F.col("l_discount"), types_of(lines)["l_discount"], [0.02, 0.07], ["low", "middle", "high"])
    return lines.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


EVENT_SPEC = C.CleaningSpec(
    missing_codes={"event_type": ["error"], "value": [0]},
    new_columns=[C.NewColumn("double_value", "value * 2 + 1"), C.NewColumn("bought", 'event_type == "purchase"'),
                 C.NewColumn("size", None, "value", (5.0, 20.0), ("small", "medium", "large"))],
    categorical=["user_id"],
    date_parts={"ts": ["month", "day_of_week", "hour"]},
)


@query("prepare_all", """
SELECT event_id, user_id::VARCHAR AS user_id, CASE WHEN event_type <> 'error' THEN event_type END AS event_type, v AS value, props,
       round(v * 2 + 1, 6) AS double_value,
       CASE WHEN event_type = 'purchase' THEN 1.0 WHEN event_type <> 'error' THEN 0.0 END::DOUBLE AS bought,
       CASE WHEN v < 5 THEN 'small' WHEN v < 20 THEN 'medium' WHEN v IS NOT NULL THEN 'large' END AS size,
       month(ts)::DOUBLE AS ts__month, (isodow(ts) - 1)::DOUBLE AS ts__day_of_week, hour(ts)::DOUBLE AS ts__hour
FROM (SELECT *, NULLIF(value, 0) AS v FROM events)""")
def prepare_all(spark, folder):
    done = C.prepare(table(spark, folder, "events"), EVENT_SPEC)
    return done.withColumn("double_value", F.round("double_value", 6))


MERGES = {"F": ["f", "F"], "O": ["o"], "P": ["p"]}


@query("label_merge", f"""
SELECT CASE WHEN trim(status_text) = 'f' THEN 'F' WHEN trim(status_text) = 'o' THEN 'O' WHEN trim(status_text) = 'p' THEN 'P'
            ELSE status_text END AS label, count(*) AS n FROM ({SQL_ORDER_TEXT}) GROUP BY 1""")
def label_merge(spark, folder):
    merged = C.merge_labels(order_text(spark, folder), "status_text", MERGES)
    return merged.groupBy(F.col("status_text").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("label_merge_rows", f"""
SELECT upper(trim(status_text)) AS label, count(*) AS rows_changed FROM ({SQL_ORDER_TEXT})
WHERE trim(status_text) IN ('f', 'o', 'p') GROUP BY 1""")
def label_merge_rows(spark, folder):
    return C.merged_rows(order_text(spark, folder), "status_text", MERGES)


PLAN = {
    "missing_value_codes": [
        {"column": "l_quantity", "values": [-999, 12345], "evidence": "no quantity is negative"},
        {"column": "l_returnflag", "values": ["R"], "evidence": "x"}],
    "categorical_columns": [{"column": "l_linenumber", "evidence": "seven codes"}, {"column": "l_linestatus", "evidence": "x"},
                            {"column": "l_orderkey", "evidence": "x"}],
    "date_features": [{"column": "l_shipdate", "parts": ["year", "hour"], "evidence": "x"},
                      {"column": "l_linestatus", "parts": ["month"], "evidence": "x"}],
    "new_columns": [{"name": "net", "formula": "l_extendedprice * (1 - l_discount)"},
                    {"name": "late", "formula": "l_quantity > 1000"}, {"name": "flag", "formula": 'l_returnflag == "R"'}],
}


@query("plan_checks", f"""
WITH s AS (SELECT count(*) AS n, count(*) FILTER (l_quantity = -999) AS a, count(*) FILTER (l_quantity = 12345) AS b,
  count(DISTINCT l_linenumber) AS c, count(DISTINCT l_orderkey) AS d, min(year(l_shipdate)) < max(year(l_shipdate)) AS e,
  min(hour(l_shipdate)) < max(hour(l_shipdate)) AS f,
  count(l_extendedprice * (1 - l_discount)) AS g, min(l_quantity > 1000) < max(l_quantity > 1000) AS h FROM ({SQL_LINE_GAPS}))
SELECT 'missing_codes' AS item, 'l_quantity' AS "column", a > 0 AS accepted FROM s
UNION ALL SELECT 'missing_codes', 'l_quantity', b > 0 FROM s
UNION ALL SELECT 'missing_codes', 'l_returnflag', false FROM s
UNION ALL SELECT 'categorical', 'l_linenumber', c <= 1000 FROM s
UNION ALL SELECT 'categorical', 'l_linestatus', false FROM s
UNION ALL SELECT 'categorical', 'l_orderkey', d <= 1000 FROM s
UNION ALL SELECT 'date_parts', 'l_shipdate', e FROM s
UNION ALL SELECT 'date_parts', 'l_shipdate', f FROM s
UNION ALL SELECT 'date_parts', 'l_linestatus', false FROM s
UNION ALL SELECT 'new_columns', 'net', g >= 0.5 * n FROM s
UNION ALL SELECT 'new_columns', 'late', h FROM s
UNION ALL SELECT 'new_columns', 'flag', false FROM s""")
def plan_checks(spark, folder):
    _, notes = judge_plan(line_gaps(spark, folder), "l_returnflag", "classification", PLAN)
    return notes.select("item", "column", "accepted")


# -- feature engineering ---------------------------------------------------------------


@query("structural_drops", f"""
WITH src AS (SELECT o_totalprice, n_name, 'k' || o_orderkey AS code, CASE WHEN o_totalprice < 100000 THEN c_acctbal END AS sparse,
                    make_timestamp(2020, 1, 1, 0, 0, 0) AS day, NULLIF(o_orderstatus, 'P') AS y FROM ({SQL_ORDER_FACTS})),
a AS (SELECT count(*) AS n, count(*) - count(sparse) AS m FROM src),
b AS (SELECT count(*) AS n, count(DISTINCT code) AS u, count(DISTINCT n_name) AS v FROM src WHERE y IS NOT NULL)
SELECT 'sparse' AS "column", 'more than 50% missing' AS reason FROM a WHERE m > 0.5 * n
UNION ALL SELECT 'day', 'date or time'
UNION ALL SELECT 'code', 'id-like' FROM b WHERE u >= 0.95 * n
UNION ALL SELECT 'n_name', 'id-like' FROM b WHERE v >= 0.95 * n""")
def structural_drops(spark, folder):
    rows = order_facts(spark, folder).select(
        "o_totalprice", "n_name", F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("code"),
        F.when(F.col("o_totalprice") < 100000, F.col("c_acctbal")).alias("sparse"),
        F.lit("2020-01-01").cast("timestamp_ntz").alias("day"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("y"))
    return E.drop_decisions(rows, "y")


@query("engineered_table", f"""
SELECT c_mktsegment, count(*) AS n, round(avg(o_totalprice), 4) AS price, count(band) AS bands FROM (
  SELECT c_mktsegment, o_totalprice, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS band FROM ({SQL_ORDER_FACTS})
  WHERE o_orderstatus <> 'P') GROUP BY 1""")
def engineered_table(spark, folder):
    facts = order_facts(spark, folder).withColumn("y", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))).drop("o_orderstatus")
    spec = C.CleaningSpec(new_columns=[C.NewColumn("band", None, "c_acctbal", (0.0,), ("debt", "credit"))])
    done = E.engineer(facts, "y", spec, ["o_orderkey"])
    return done.table.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("price"), F.count("band").alias("bands"))


@query("feature_report", f"""
WITH src AS (SELECT * FROM ({SQL_ORDER_FACTS}) WHERE o_orderstatus <> 'P')
SELECT 'dropped' AS step, 'o_orderkey' AS "column", 'per analysis' AS detail
UNION ALL SELECT 'cleaned', 'band', 'new column: ranges of c_acctbal'
UNION ALL SELECT 'encoded', c, CASE WHEN u <= 10 THEN 'one_hot' ELSE 'ordinal' END || ', ' || u || ' levels' FROM (
  SELECT 'n_name' AS c, count(DISTINCT n_name) AS u FROM src UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM src
  UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM src
  UNION ALL SELECT 'band', count(DISTINCT c_acctbal < 0) FROM src)
UNION ALL SELECT 'result', 'features', '6' UNION ALL SELECT 'result', 'rows', count(*)::VARCHAR FROM src""")
def feature_report(spark, folder):
    facts = order_facts(spark, folder).withColumn("y", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))).drop("o_orderstatus")
    spec = C.CleaningSpec(new_columns=[C.NewColumn("band", None, "c_acctbal", (0.0,), ("debt", "credit"))])
    return E.engineer(facts, "y", spec, ["o_orderkey"]).report


WORDS = ["o_orderstatus", "o_orderpriority", "c_mktsegment", "n_name"]


@query("encoding_plan", f"WITH src AS ({SQL_ORDER_FACTS}) " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CASE WHEN u <= 10 THEN 'one_hot' ELSE 'ordinal' END AS encoding, u AS levels
    FROM (SELECT count(DISTINCT {c}) AS u FROM src)""" for c in WORDS))
def encoding_plan(spark, folder):
    return E.encoding_plan(order_facts(spark, folder), "o_totalprice")


@query("form_values", f"""
WITH src AS (SELECT o_orderpriority AS p, ' ' || c_mktsegment AS s, (o_orderkey % 12)::VARCHAR AS code, n_name || o_orderkey AS many FROM ({SQL_ORDER_FACTS}))
SELECT 'p' AS "column", string_agg(v, '|' ORDER BY lower(v), v) AS choices FROM (SELECT DISTINCT trim(p) AS v FROM src)
UNION ALL SELECT 's', string_agg(v, '|' ORDER BY lower(v), v) FROM (SELECT DISTINCT trim(s) AS v FROM src)
UNION ALL SELECT 'code', string_agg(v, '|' ORDER BY v::DOUBLE) FROM (SELECT DISTINCT code AS v FROM src)""")
def form_values(spark, folder):
    rows = order_facts(spark, folder).select(
        F.col("o_orderpriority").alias("p"), F.concat(F.lit(" "), F.col("c_mktsegment")).alias("s"),
        (F.col("o_orderkey") % 12).cast("string").alias("code"),
        F.concat("n_name", F.col("o_orderkey").cast("string")).alias("many"))
    return E.form_values(rows).select("column", F.concat_ws("|", "choices").alias("choices"))


@query("impute_mode", f"WITH src AS ({SQL_ORDER_FACTS}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", v AS value FROM (SELECT {c} AS v, count(*) AS n FROM src WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1)"
    for c in WORDS))
def impute_mode(spark, folder):
    return E.most_frequent(order_facts(spark, folder), WORDS)


GAPPY = ["l_quantity", "l_discount", "l_tax"]


@query("impute_median", f"WITH src AS ({SQL_LINE_GAPS}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(quantile_cont({c}, 0.5), 6) AS median FROM src" for c in GAPPY))
def impute_median(spark, folder):
    return E.medians(line_gaps(spark, folder), GAPPY).select("column", F.round("median", 6).alias("median"))


@query("standardise", f"""
WITH src AS (SELECT l_orderkey, l_partkey, l_tax FROM ({SQL_LINE_GAPS})), m AS (SELECT quantile_cont(l_tax, 0.5) AS md FROM src),
s AS (SELECT avg(coalesce(l_tax, md)) AS mu, stddev_pop(coalesce(l_tax, md)) AS sd FROM src, m)
SELECT l_orderkey, l_partkey, round((coalesce(l_tax, md) - mu) / sd, 6) AS l_tax FROM src, m, s""")
def standardise(spark, folder):
    lines = line_gaps(spark, folder)
    encoder = E.Encoder.fit(lines, ["l_tax"], "scaled")
    median, mean, std = encoder.scale["l_tax"]
    value = (F.coalesce(F.col("l_tax"), F.lit(median)) - mean) / std
    return lines.select("l_orderkey", "l_partkey", F.round(value, 6).alias("l_tax"))


@query("one_hot", """
SELECT o_orderkey, (o_orderpriority = '1-URGENT')::INT::DOUBLE AS u, (o_orderpriority = '2-HIGH')::INT::DOUBLE AS h,
       (o_orderpriority = '3-MEDIUM')::INT::DOUBLE AS m, (o_orderpriority = '4-NOT SPECIFIED')::INT::DOUBLE AS n,
       (o_orderpriority = '5-LOW')::INT::DOUBLE AS l, (o_orderkey % 2 = 1)::INT::DOUBLE AS odd FROM orders""")
def one_hot(spark, folder):
    orders = table(spark, folder, "orders").withColumn("side", F.when(F.col("o_orderkey") % 2 == 1, "odd").otherwise("even"))
    encoder = E.Encoder.fit(orders, ["o_orderpriority", "side"], "tree")
    names = dict(zip(["o_orderpriority_1-URGENT", "o_orderpriority_2-HIGH", "o_orderpriority_3-MEDIUM",
                      "o_orderpriority_4-NOT SPECIFIED", "o_orderpriority_5-LOW", "side_odd"], "u h m n l odd".split()))
    from pyspark.ml.functions import vector_to_array
    flat = encoder.transform(orders).withColumn("v", vector_to_array("features"))
    return flat.select("o_orderkey", *[F.col("v")[i].alias(names[n]) for i, n in enumerate(encoder.names())])


@query("ordinal", """
SELECT o_orderkey, o_custkey, coalesce(code, -1)::BIGINT AS code FROM (
  SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey) o
LEFT JOIN (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS code FROM (
  SELECT DISTINCT c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'P')) USING (c_name)""")
def ordinal(spark, folder):
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")
    named = orders.join(customers, orders["o_custkey"] == customers["c_custkey"], "left").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "c_name")
    codes = E.level_codes(named.filter("o_orderstatus <> 'P'"), "c_name")
    joined = named.join(codes, named["c_name"] == codes["level"], "left")
    return joined.select("o_orderkey", "o_custkey", F.coalesce("code", F.lit(-1)).cast("bigint").alias("code"))


@query("rare_pooling", f"""
WITH src AS ({SQL_ORDER_FACTS}), a AS (SELECT n_name AS level, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, n_name) AS r,
  count(*) OVER () AS levels FROM src GROUP BY 1)
SELECT 'n_name' AS "column", level, n FROM a WHERE levels <= 20 OR r <= 19
UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*) FROM src GROUP BY 2""")
def rare_pooling(spark, folder):
    return E.frequent_levels(order_facts(spark, folder), ["n_name", "c_mktsegment"])


@query("encoder_description", f"""
WITH src AS ({SQL_ORDER_FACTS})
SELECT 'o_totalprice' AS "column", 'as is' AS treatment, 'o_totalprice' AS outputs
UNION ALL SELECT 'c_mktsegment', 'one_hot', string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT c_mktsegment AS v FROM src)
UNION ALL SELECT 'n_name', 'ordinal', string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT n_name AS v FROM src)""")
def encoder_description(spark, folder):
    encoder = E.Encoder.fit(order_facts(spark, folder), ["o_totalprice", "c_mktsegment", "n_name"], "tree")
    return encoder.describe(spark).withColumn("outputs", F.concat_ws("|", "outputs"))
