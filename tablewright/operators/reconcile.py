"""Keeping a dimension in step with its spine, and labels derived by ordered keyword rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.kinds import q
from tablewright.operators.ordering import position


def reconcile(
    spine: DataFrame, existing: DataFrame, key: str, spine_order: str, row_order: str, values: Sequence[str],
    removed: Sequence[str] = (), renamed: Mapping[str, str] | None = None, overrides: DataFrame | None = None,
    defaults: Mapping[str, object] | None = None,
) -> DataFrame:
    """One row per spine key, in spine order and numbered from 1: ``(no, key, values.., added)``.

    Existing rows lose blank and removed keys, take their new name, and the last row of a key
    wins; absent keys are filled from the overrides and then from the defaults. ``added`` marks them.
    """
    name = F.trim(q(key))
    kept = existing.filter(name.isNotNull() & (name != ""))
    if removed:
        kept = kept.filter(~name.isin(list(removed)))
    new_name: Column = name
    for old, new in (renamed or {}).items():
        new_name = F.when(name == old, new).otherwise(new_name)
    # The last row per key as an aggregate: combined before the shuffle, so a frequent key is no hot spot.
    last = kept.groupBy(new_name.alias("__key")).agg(
        F.max_by(F.struct(*[q(v) for v in values]), q(row_order)).alias("__row"))
    joined = spine.select(q(key), q(spine_order).alias("__at")).join(last, q(key) == F.col("__key"), "left")
    filled = {v: F.col(f"__row.{v}") for v in values}
    if overrides is not None:
        over = overrides.select(q(key).alias("__okey"), *[q(v).alias(f"__o_{v}") for v in values])
        joined = joined.join(over, q(key) == F.col("__okey"), "left")
        filled = {v: F.when(F.col("__key").isNotNull(), c).otherwise(F.col(f"__o_{v}")) for v, c in filled.items()}
    present = F.col("__key").isNotNull()
    for v in values:
        fallback = F.lit((defaults or {}).get(v))
        filled[v] = F.when(present, filled[v]).otherwise(F.coalesce(filled[v], fallback))
    out = joined.select(q(key), "__at", *[c.alias(v) for v, c in filled.items()], (~present).alias("added"))
    numbered = position(out, [F.col("__at")], "no")
    return numbered.select("no", q(key), *[q(v) for v in values], "added")


def first_rule(text: Column, rules: Mapping[str, str], default: str) -> Column:
    """The value of the first rule whose keyword the text contains, ignoring case."""
    low = F.lower(text)
    hits = [F.when(low.contains(word.lower()), F.lit(value)) for word, value in rules.items()]
    return F.coalesce(*hits, F.lit(default))


def matching_rules(rules: Sequence[tuple[Column, Sequence[str], str, str]], default: Mapping[str, str]) -> Column:
    """All rules that apply, as a JSON object: each is (text, keywords, name, value); the default when none does."""
    entries = []
    for text, keywords, name, value in rules:
        low = F.lower(text)
        hit = F.lit(False)
        for word in keywords:
            hit = hit | F.coalesce(low.contains(word.lower()), F.lit(False))
        entries.append(F.when(hit, F.struct(F.lit(name).alias("k"), F.lit(value).alias("v"))))
    found = F.filter(F.array(*entries), lambda e: e.isNotNull())
    fallback = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in default.items()])
    chosen = F.when(F.size(found) > 0, found).otherwise(fallback)
    return F.to_json(F.map_from_entries(chosen))


def first_tags(text: Column, tags: Sequence[tuple[Sequence[str], str]], default: Sequence[str], n: int = 2) -> Column:
    """The first ``n`` tags whose keywords the text contains, joined by `` + ``."""
    low = F.lower(text)
    entries = []
    for keywords, tag in tags:
        hit = F.lit(False)
        for word in keywords:
            hit = hit | F.coalesce(low.contains(word.lower()), F.lit(False))
        entries.append(F.when(hit, F.lit(tag)))
    found = F.filter(F.array(*entries), lambda t: t.isNotNull())
    chosen = F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(t) for t in default]))
    return F.concat_ws(" + ", F.slice(chosen, 1, n))
