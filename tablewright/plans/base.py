"""The register of queries: each has a Spark form and, where SQL can say it, an equivalent statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.hashing import fold_edges

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}

LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql_hash(seed: int, keys: list[str]) -> str:
    """The statement for :func:`tablewright.functions.hashing.row_hash`."""
    return f"md5(concat_ws(':', '{seed}', {', '.join(keys)}))"


def sql_fold(seed: int, keys: list[str], folds: int) -> str:
    """The statement for :func:`tablewright.functions.hashing.hash_fold`."""
    h = f"substr({sql_hash(seed, keys)}, 1, 8)"
    return "(" + " + ".join(f"({h} >= '{e}')::INT" for e in fold_edges(folds)) + ")"


# -- shared views of the tables, with planted gaps, leaks and targets ------------------------
# The tables have no gaps and independent columns, so these are planted by rules that
# both engines can repeat. Every view keeps all rows of its table.


def line_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with missing values and a missing-value code."""
    return table(spark, folder, "lineitem").select(
        *LINE_KEY,
        F.when(F.col("l_suppkey") % 10 == 0, -999.0).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax")).alias("l_tax"),
        "l_returnflag", "l_linestatus", "l_shipdate",
    )


SQL_LINE_GAPS = """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
           CASE WHEN l_suppkey % 10 = 0 THEN -999.0::DOUBLE ELSE l_quantity END AS l_quantity,
           l_extendedprice, NULLIF(l_discount, 0) AS l_discount,
           CASE WHEN l_linenumber % 2 = 0 THEN l_tax END AS l_tax, l_returnflag, l_linestatus, l_shipdate
    FROM lineitem"""


def line_total(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with a total that three columns rebuild, and a class it decides."""
    total = F.col("l_quantity") + 500 * F.col("l_discount") + 500 * F.col("l_tax")
    lines = table(spark, folder, "lineitem").withColumn("total", total)
    return lines.withColumn("late", F.when(F.col("total") >= 70, "late").otherwise("on time"))


SQL_LINE_TOTAL = """
    SELECT *, CASE WHEN total >= 70 THEN 'late' ELSE 'on time' END AS late
    FROM (SELECT *, l_quantity + 500 * l_discount + 500 * l_tax AS total FROM lineitem)"""


def line_net(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with a net price, which almost gives the price away."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, folder, "lineitem").withColumn("net", net)


SQL_LINE_NET = "SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem"


def order_text(spark: SparkSession, folder: str) -> DataFrame:
    """orders with amounts, dates and labels as people write them."""
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.concat(F.lit("$"), F.col("o_orderkey").cast("string"), F.lit(",000")).alias("amount"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lower("o_orderstatus"))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.col("o_orderstatus"), F.lit(" ")))
        .otherwise(F.col("o_orderstatus")).alias("status_text"),
        F.col("o_orderpriority").alias("priority"),
    )


SQL_ORDER_TEXT = """
    SELECT o_orderkey, '$' || o_orderkey || ',000' AS amount, strftime(o_orderdate, '%Y-%m-%d') AS day_text,
           CASE o_orderkey % 3 WHEN 0 THEN lower(o_orderstatus) WHEN 1 THEN o_orderstatus || ' '
                ELSE o_orderstatus END AS status_text,
           o_orderpriority AS priority
    FROM orders"""


def order_facts(spark: SparkSession, folder: str) -> DataFrame:
    """orders with the customer's segment and nation."""
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer")
    nations = table(spark, folder, "nation")
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    joined = joined.join(nations, joined["c_nationkey"] == nations["n_nationkey"])
    return joined.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "c_mktsegment",
                         "c_acctbal", "n_name")


SQL_ORDER_FACTS = """
    SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority, c_mktsegment, c_acctbal, n_name
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """labels with the document they judge."""
    labels = table(spark, folder, "labels")
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return labels.join(documents, "doc_id").withColumn("quality", F.col("quality").cast("string"))


SQL_LABELLED = """
    SELECT l.doc_id, l.quality::VARCHAR AS quality, l.toxic, d.lang, d.source, d.n_chars
    FROM labels l JOIN documents d USING (doc_id)"""


def class_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """A prediction table for two classes: label, score and prediction."""
    score = (10 * F.col("l_discount") + F.col("l_tax")) / 2
    lines = table(spark, folder, "lineitem").select(*LINE_KEY, F.col("l_linestatus").alias("label"), score.alias("score"))
    return lines.withColumn("prediction", F.when(F.col("score") >= 0.3, "O").otherwise("F"))


SQL_CLASS_PREDICTIONS = """
    SELECT *, CASE WHEN score >= 0.3 THEN 'O' ELSE 'F' END AS prediction
    FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_linestatus AS label,
                 (10 * l_discount + l_tax) / 2 AS score FROM lineitem)"""


def value_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """A prediction table for a number."""
    guess = F.col("l_quantity") * (1 + F.col("l_discount") - F.col("l_tax"))
    return table(spark, folder, "lineitem").select(*LINE_KEY, F.col("l_quantity").alias("label"), guess.alias("prediction"))


SQL_VALUE_PREDICTIONS = """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS label,
           l_quantity * (1 + l_discount - l_tax) AS prediction FROM lineitem"""


def fold_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A log of fold scores: suppliers stand for trials and line numbers for folds."""
    return table(spark, folder, "lineitem").groupBy(
        F.col("l_suppkey").alias("trial"), F.col("l_linenumber").alias("fold")
    ).agg(F.avg(F.sqrt(F.col("l_discount") + F.col("l_tax"))).alias("score"))


SQL_FOLD_SCORES = """
    SELECT l_suppkey AS trial, l_linenumber AS fold, avg(sqrt(l_discount + l_tax)) AS score
    FROM lineitem GROUP BY 1, 2"""


