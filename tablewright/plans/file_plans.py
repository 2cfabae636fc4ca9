"""Readers and sinks: tables are written to the shared folder in the formats people use and read back."""

import uuid

from pyspark.sql import functions as F

from tablewright.plans.base import query, table
from tablewright.session import shared_folder
from tablewright.sources import readers, writers
from tablewright.sources.digests import content_digests


def scratch(spark, name, extension):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}.{extension}"


@query("read_delimited", """
SELECT o_orderkey AS "key", o_totalprice AS price, o_orderkey % 2 = 0 AS even, strftime(o_orderdate, '%Y-%m-%d') AS "day",
       CASE WHEN o_orderkey % 5 > 0 THEN '"' || o_orderstatus || '", ' || chr(10) || ' of ' || o_orderpriority END AS "note, quoted"
FROM orders""")
def read_delimited(spark, folder):
    """Numbers, flags, dates that stay text, gaps, and quoted text with delimiters, quotes and line breaks."""
    key = F.col("o_orderkey")
    note = F.concat(F.lit('"'), "o_orderstatus", F.lit('", \n of '), "o_orderpriority")
    rows = table(spark, folder, "orders").select(
        key.alias("key"), F.col("o_totalprice").alias("price"), F.when(key % 2 == 0, "True").otherwise("False").alias("even"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.when(key % 5 > 0, note).alias("note, quoted"))
    path = scratch(spark, "orders", "csv")
    writers.write_csv(rows, path)
    return readers.ingest(spark, path).table


@query("delimiter_per_file", """
SELECT o_orderkey, o_totalprice, o_orderpriority || CASE WHEN o_orderkey % 3 = 2 THEN ' é ¼' ELSE '' END AS o_orderpriority FROM orders""")
def delimiter_per_file(spark, folder):
    """One folder, three ways of writing: other delimiters, other encodings, columns in another order."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    path = scratch(spark, "mixed", "csv")
    third = F.col("o_orderkey") % 3
    first = orders.where(third == 0)
    first.write.mode("append").csv(path, sep=";", header=True)
    orders.where(third == 1).select("o_orderpriority", "o_orderkey", "o_totalprice").write.mode("append").csv(path, sep="\t", header=True)
    marked = orders.where(third == 2).withColumn("o_orderpriority", F.concat("o_orderpriority", F.lit(" é ¼")))
    marked.write.mode("append").csv(path, sep="|", header=True, encoding="iso-8859-1")
    return readers.ingest(spark, path).table.select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("surplus_fields", """
SELECT l_orderkey || ',"a,b",' || l_returnflag || ',surplus,"x,y"' AS line FROM lineitem WHERE l_linenumber = 3""")
def surplus_fields(spark, folder):
    """The records that have more fields than the header; short ones are none of them."""
    at = F.col("l_linenumber")
    line = F.concat(F.col("l_orderkey").cast("string"), F.lit(',"a,b"'), F.when(at == 1, "").otherwise(F.concat(F.lit(","), "l_returnflag")),
                    F.when(at == 3, ',surplus,"x,y"').otherwise(""))
    path = scratch(spark, "surplus", "csv")
    # Lines are written as they are: the delimiter and quote of this write stand in none of them.
    table(spark, folder, "lineitem").select(line.alias("key,pair,flag")).write.csv(path, header=True, sep="\x01", quote="\x02")
    return readers.surplus_lines(spark, path)


@query("read_json_lines", """
SELECT event_id, user_id, "value", event_type AS "about.event_type", (props ->> '$.k')::BIGINT AS "about.k" FROM events""")
def read_json_lines(spark, folder):
    about = F.struct("event_type", F.from_json("props", "k bigint")["k"].alias("k")).alias("about")
    path = scratch(spark, "events", "jsonl")
    writers.write_report(table(spark, folder, "events").select("event_id", "user_id", "value", about), path)
    return readers.ingest(spark, path).table


@query("read_json_records", """
SELECT s_suppkey, s_acctbal, s_name AS "who.name", s_nationkey FROM supplier""")
def read_json_records(spark, folder):
    """A folder of JSON documents, each a list of records: one per nation, which is part of the file's place."""
    record = F.struct("s_suppkey", "s_acctbal", F.struct(F.col("s_name").alias("name")).alias("who"))
    lists = table(spark, folder, "supplier").groupBy("s_nationkey").agg(F.to_json(F.collect_list(record)).alias("value"))
    path = scratch(spark, "suppliers", "json")
    lists.repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    return readers.read_table(spark, path)[0]


@query("source_fingerprint", """
SELECT sha256(v) AS sha256, length(v)::BIGINT AS bytes
FROM (SELECT string_agg(s_name || chr(10), '' ORDER BY s_name) AS v FROM supplier GROUP BY s_nationkey)""")
def source_fingerprint(spark, folder):
    path = scratch(spark, "names", "txt")
    names = table(spark, folder, "supplier").groupBy("s_nationkey").agg(F.array_join(F.sort_array(F.collect_list("s_name")), "\n").alias("value"))
    names.repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    return readers.fingerprint(spark, f"{path}/*/*.txt").select("sha256", "bytes")


@query("content_digest", """
SELECT sha256(sha256(sha256(v))) AS tree_sha256, count(*)::BIGINT AS files
FROM (SELECT string_agg(s_name || chr(10), '' ORDER BY s_name) AS v FROM supplier GROUP BY s_nationkey) GROUP BY 1""")
def content_digest(spark, folder):
    """The hash over blocks of every file: here each file is one block of one group."""
    path = scratch(spark, "blocks", "txt")
    names = table(spark, folder, "supplier").groupBy("s_nationkey").agg(F.array_join(F.sort_array(F.collect_list("s_name")), "\n").alias("value"))
    names.repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    return content_digests(spark, f"{path}/*/*.txt").groupBy("tree_sha256").agg(F.count("*").alias("files"))


@query("replaced_table", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber <= 4")
def replaced_table(spark, folder):
    """A stored table is replaced by one that is read from it."""
    path = scratch(spark, "replaced", "parquet")
    writers.write_table(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), path)
    writers.write_table(spark.read.parquet(path).where("l_linenumber <= 4"), path)
    return spark.read.parquet(path)


@query("parquet_sink", "SELECT l_orderkey, l_quantity, l_shipdate FROM lineitem")
def parquet_sink(spark, folder):
    path = scratch(spark, "lines", "parquet")
    writers.write_table(table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate"), path)
    return readers.load_columns(spark, path, readers.columns_of_table(spark, path))


@query("predictions_sink", """
SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS prediction, o_totalprice / 1000000 AS probability
FROM orders""")
def predictions_sink(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_totalprice") > 100_000, "high").otherwise("low").alias("prediction"),
        (F.col("o_totalprice") / 1_000_000).alias("probability"))
    path = scratch(spark, "predictions", "csv")
    writers.write_predictions(rows, path)
    return readers.read_table(spark, path)[0]


@query("report_sink", """
SELECT o_orderpriority AS "column", count(*)::BIGINT AS "rows", NULL::VARCHAR AS detail FROM orders GROUP BY 1""")
def report_sink(spark, folder):
    report = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("column")).agg(F.count("*").alias("rows"))
    path = scratch(spark, "report", "json")
    writers.write_report(report.withColumn("detail", F.lit(None).cast("string")), path)
    return spark.read.json(path, schema="`column` string, rows bigint, detail string")
