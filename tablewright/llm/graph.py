"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``vertex`` and ``label`` (the smallest vertex it reaches) for every vertex that has a link.

    Each round links every vertex's larger neighbours to its smallest one, then its smaller
    neighbours and itself to the smallest of them, and writes the result; rounds grow with the
    logarithm of the vertices. Neighbours are never gathered: minima are combined per task, and the
    join back is one that adaptive execution splits where a vertex has very many links.
    """
    edges = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("v != u")
    edges, seen = _settled(edges)
    while True:
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).withColumn("m", F.least("v", "m"))
        larger = both.join(least, "v").where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        larger = larger.where("v != u")
        smallest = larger.groupBy("v").agg(F.min("u").alias("m"))
        smaller = larger.join(smallest, "v").where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        smaller = smaller.union(smallest.select("v", F.col("m").alias("u")))
        edges, now = _settled(smaller)
        if now == seen:
            break
        seen = now
    own = edges.select(F.col("u").alias("vertex"), F.col("u").alias("label")).distinct()
    return edges.select(F.col("v").alias("vertex"), F.col("u").alias("label")).union(own)


def _settled(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct edges on shared files, and a signature by which equal edge sets are known."""
    edges = written(edges.distinct(), "links")
    return edges, tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
