"""Containment between two tables of names without comparing every pair.

If a name contains a needle, it contains the needle's rarest gram. So every needle is
filed under one gram, every name is split into its grams, and the two meet in an
equi-join whose few survivors are checked in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3


def _grams(value: Column, size: int) -> Column:
    """The distinct substrings of one size (none when the text is shorter)."""
    last = F.length(value) - size + 1
    spots = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(spots, lambda i: F.substring(value, i, F.lit(size))))


def containing(names: DataFrame, needles: DataFrame, name: str = "name", needle: str = "needle") -> DataFrame:
    """Pairs where ``name`` contains ``needle``; all columns of both sides. An empty needle is in every name."""
    by_name = names.select(F.col(name).alias("__n")).distinct()
    all_grams = F.flatten(F.array(*[_grams(F.col("__n"), s) for s in range(1, GRAM + 1)]))
    grams = by_name.select("__n", F.explode(F.concat(F.array(F.lit("")), all_grams)).alias("gram"))
    frequency = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("names"))

    by_needle = needles.select(F.col(needle).alias("__k")).distinct()
    size = F.least(F.length("__k"), F.lit(GRAM))
    own = F.when(size == 0, F.array(F.lit(""))).when(size == 1, _grams(F.col("__k"), 1)).when(
        size == 2, _grams(F.col("__k"), 2)).otherwise(_grams(F.col("__k"), GRAM))
    # A needle one of whose grams is in no name matches nothing and drops out here.
    filed = by_needle.select("__k", F.explode(own).alias("gram")).join(frequency, "gram")
    rarest = Window.partitionBy("__k").orderBy("names", "gram")
    filed = filed.withColumn("rank", F.row_number().over(rarest)).filter("rank = 1").select("__k", "gram")
    pairs = grams.join(filed, "gram").filter(F.contains("__n", "__k")).select("__n", "__k")
    return pairs.join(names, pairs["__n"] == F.col(name)).join(needles, pairs["__k"] == F.col(needle)).drop("__n", "__k")
