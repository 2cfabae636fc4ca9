"""Mixing sources to target weights: how often each document is repeated so that sources come near their targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.text import unit_hash, word_count
from tablewright.operators.ordering import running_totals
from tablewright.session import written

WEIGHTS = (5, 2, 1)  # by code point of the source, repeating
MOST_REPEATS = 3
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """One row per source: its size, weight and target.

    ``sizes`` has ``__source`` and ``__size``. Sources are ordered by code point, null last, and the
    weights repeat along that order. Targets share the whole size by weight; one that would pass
    ``most`` times its source stops there and the excess goes to the others by weight. A source is
    one of the stopped ones exactly when, with all sources of a smaller size per weight stopped, its
    share of the rest still reaches its limit, so running totals in that order give the final share
    without rounds.
    """
    sources = written(sizes.groupBy("__source").agg(F.sum("__size").alias("source_size")), "sources")
    count = sources.count()
    ranked = running_totals(sources, [F.col("__source").asc_nulls_last()], {"rank": F.lit(1).cast("bigint")}, rows=count)
    table = F.array(*[F.lit(int(w)).cast("bigint") for w in weights])
    weighted = ranked.withColumn("weight", F.element_at(table, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    weighted = weighted.withColumn("__limit", F.lit(most) * F.col("source_size"))
    ordered = running_totals(
        weighted, [(F.col("__limit") / F.col("weight")).asc(), F.col("rank").asc()],
        {"__limits": F.col("__limit"), "__weights": F.col("weight")}, rows=count)
    totals = weighted.agg(F.sum("source_size").alias("__all"), F.sum("weight").alias("__all_weights"))  # one row
    shared = ordered.join(F.broadcast(totals)).withColumn(
        "__share",
        (F.col("__all") - F.col("__limits") + F.col("__limit")).cast("double")
        / (F.col("__all_weights") - F.col("__weights") + F.col("weight")).cast("double"))
    shared = written(shared.withColumn("__stopped", F.col("__limit") / F.col("weight") <= F.col("__share")), "shares")
    rest = shared.where(~F.col("__stopped")).agg(F.max("__share").alias("__rest"))  # one row
    return shared.join(F.broadcast(rest)).select(
        "__source", "source_size", "weight",
        F.when(F.col("__stopped"), F.col("__limit").cast("double"))
        .otherwise(F.least(F.col("__limit").cast("double"), F.col("__rest") * F.col("weight"))).alias("target"))


def plan_mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 17,
    text: str = "text", source: str = "source", key: str = "doc_id",
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``, one row per document.

    A document's rate is its source's target over its source's size. It is taken floor(rate) times,
    and once more where the hash of seed and key falls below the fraction. Nulls: a null text has
    size 0, null sources are one source, null keys draw alike. Rows that repeat a key draw alike.
    Empty tables give no rows, empty sources get target 0. Columns of ``docs`` with one of the four
    names are replaced.
    """
    added = ("size", "source_size", "target", "copies")
    given = [c for c in docs.columns if c not in added]
    sized = docs.withColumns({"__size": word_count(F.col(text)), "__source": F.col(source).cast("string")})
    targets = source_targets(sized.select("__source", "__size"), weights, most)
    targets = targets.select(F.col("__source").alias("__of"), "source_size", "target")
    if targets.count() <= BROADCAST_SOURCES:  # more are joined by key, where adaptive execution splits a heavy source
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = sized.drop(*added).join(targets, F.col("__source").eqNullSafe(F.col("__of")))
    return joined.withColumn("__rate", rate).select(
        *[F.col(f"`{c}`") for c in given], F.col("__size").alias("size"), "source_size", "target",
        _copies(F.col("__rate"), unit_hash(seed, F.col(key))).alias("copies"))


def _copies(rate: Column, draw: Column) -> Column:
    whole = F.floor(rate).cast("bigint")
    return whole + (draw < rate - whole).cast("bigint")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Every document as often as the plan says, with ``copy`` numbered from 0."""
    planned = plan_mix(docs, **options).where(F.col("copies") > 0)
    return planned.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
