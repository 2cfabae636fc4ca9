"""Normalising a freshly read table; every change is one row of the report."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import values as V
from tablewright.functions.kinds import q

REPORT = "step string, column string, detail string"


class IngestError(ValueError):
    """The input cannot be turned into a table; the message is safe to show."""


@dataclass(frozen=True)
class Ingested:
    """A table and what was done to get it: ``(step, column, detail)`` rows."""

    table: DataFrame
    report: DataFrame


def repair_names(names: Sequence[str]) -> tuple[list[str], list[tuple[str, str, str]]]:
    """Trim names, name blank ones by position, and number repeats by the next number that is free.

    A number is free if no column carries that name, before or after it. Names that differ only in
    case are repeats, as column names do not tell case apart.
    """
    wanted = [raw.strip() or f"column_{at}" for at, raw in enumerate(names, 1)]
    reserved, used = {w.lower() for w in wanted}, set()

    def free(name: str) -> str:
        if name.lower() not in used:
            return name
        return next(f"{name}_{n}" for n in itertools.count(2) if f"{name}_{n}".lower() not in reserved | used)

    out: list[str] = []
    for name in wanted:
        out.append(free(name))
        used.add(out[-1].lower())
    return out, [("renamed", new, f"was {raw!r}") for raw, new in zip(names, out) if new != raw]


def flatten(df: DataFrame) -> DataFrame:
    """Struct fields as columns with dotted names, at any depth."""
    def leaves(path: str, shown: str, data_type: T.DataType) -> list[Column]:
        if not isinstance(data_type, T.StructType):
            return [F.col(path).alias(shown)]
        out: list[Column] = []
        for f in data_type.fields:
            out += leaves(f"{path}.`{f.name.replace('`', '``')}`", f"{shown}.{f.name}", f.dataType)
        return out

    columns: list[Column] = []
    for f in df.schema.fields:
        columns += leaves("`" + f.name.replace("`", "``") + "`", f.name, f.dataType)
    return df.select(*columns)


def storable(df: DataFrame) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """Arrays and maps as JSON text, decimals as doubles, NaN as missing."""
    columns, notes = [], []
    for f in df.schema.fields:
        c = q(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType)):
            columns.append(F.to_json(c).alias(f.name))
            notes.append(("stored", f.name, "as text (held nested values)"))
        elif isinstance(f.dataType, T.DecimalType):
            columns.append(c.cast("double").alias(f.name))
            notes.append(("stored", f.name, "as numeric (held decimals)"))
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            columns.append(F.when(~F.isnan(c), c).alias(f.name))
        else:
            columns.append(c.alias(f.name))
    return df.select(*columns), notes


def blank_tokens(df: DataFrame) -> DataFrame:
    """The standard missing-value tokens of text columns as NULL (exact matches only)."""
    return df.select(*[
        F.when(~q(f.name).isin(*V.MISSING_TOKENS), q(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else q(f.name)
        for f in df.schema.fields
    ])


def normalize(df: DataFrame) -> Ingested:
    """Repair names, drop empty columns and rows, and make every column storable."""
    names, notes = repair_names(df.columns)
    df, stored = storable(flatten(df.toDF(*names)))
    if not df.columns:
        raise IngestError("No row of the file holds a value.")
    gaps = F.count_if(~_any_value(df)).alias("blank")
    seen = df.agg(F.count(F.lit(1)).alias("rows"), gaps, *[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    void = [c for i, c in enumerate(df.columns) if seen[f"n{i}"] == 0]
    notes += [("dropped", c, "completely empty column") for c in void]
    kept = [c for c in df.columns if c not in void]
    if seen["blank"]:
        notes.append(("dropped", None, f"{seen['blank']} completely empty row(s)"))
    if not kept or seen["rows"] == seen["blank"]:
        raise IngestError("No row of the file holds a value.")
    table = df.select(*[q(c) for c in kept])
    if seen["blank"]:
        table = table.filter(_any_value(table))
    notes += [n for n in stored if n[1] in kept]
    types = dict(table.dtypes)
    notes += [("dtype", c, types[c]) for c in kept]
    notes += [("rows", None, str(seen["rows"] - seen["blank"])), ("columns", None, str(len(kept)))]
    return Ingested(table, df.sparkSession.createDataFrame(notes, REPORT))


def _any_value(df: DataFrame) -> Column:
    return F.coalesce(*[F.when(q(c).isNotNull(), True) for c in df.columns], F.lit(False))
