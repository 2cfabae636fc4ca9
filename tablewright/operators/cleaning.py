"""One cleaning transform for training, scoring and streams."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import values as V
from tablewright.functions.formula import formula_column, formula_columns, range_column
from tablewright.functions.kinds import q

@dataclass(frozen=True)
class NewColumn:
    """A derived column: a formula, or ranges of one column."""

    name: str
    formula: str | None = None
    column: str | None = None
    edges: tuple[float, ...] = ()
    labels: tuple[str, ...] = ()

    def sources(self) -> list[str]:
        return formula_columns(self.formula) if self.formula else [self.column or ""]

    def build(self, types: Mapping[str, T.DataType]) -> Column:
        if self.formula:
            return formula_column(self.formula, dict(types))
        return range_column(q(self.column), types[self.column], list(self.edges), list(self.labels))


@dataclass(frozen=True)
class CleaningSpec:
    """What ``prepare`` does to raw columns, and which target labels are one class."""

    missing_codes: Mapping[str, Sequence[object]] = field(default_factory=dict)
    new_columns: Sequence[NewColumn] = ()
    categorical: Sequence[str] = ()
    date_parts: Mapping[str, Sequence[str]] = field(default_factory=dict)
    label_merges: Mapping[str, Sequence[str]] = field(default_factory=dict)  # kept label -> its variants

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "CleaningSpec":
        raw = json.loads(text)
        new = [NewColumn(c["name"], c["formula"], c["column"], tuple(c["edges"]), tuple(c["labels"]))
               for c in raw["new_columns"]]
        return CleaningSpec(raw["missing_codes"], new, raw["categorical"], raw["date_parts"], raw["label_merges"])


def column_sources(spec: CleaningSpec) -> dict[str, list[str]]:
    """For every column the spec makes, the raw columns it comes from."""
    out = {f"{c}__{p}": [c] for c, parts in spec.date_parts.items() for p in parts}
    out.update({new.name: new.sources() for new in spec.new_columns})
    return out


def prepare(df: DataFrame, spec: CleaningSpec | None) -> DataFrame:
    """Apply the spec: codes to missing, then new columns, then codes to categories, then date parts.

    Row by row and stateless: the selects collapse into one stage, and a streaming
    DataFrame works as well as a batch one.
    """
    if spec is None:
        return df
    types = {f.name: f.dataType for f in df.schema.fields}
    coded = {c: codes for c, codes in spec.missing_codes.items() if c in types}
    if coded:
        df = df.withColumns({
            c: F.when(~V.is_code(q(c), types[c], codes), q(c)) for c, codes in coded.items()
        })
    for new in spec.new_columns:
        if all(c in types for c in new.sources()):
            df = df.withColumn(new.name, new.build(types))
            types[new.name] = T.DoubleType() if new.formula else T.StringType()
    labels = [c for c in spec.categorical if c in types]
    if labels:
        df = df.withColumns({c: V.code_label(q(c), types[c]) for c in labels})
        types.update({c: T.StringType() for c in labels})
    dates = {c: parts for c, parts in spec.date_parts.items() if c in types}
    if dates:
        parts_of = {
            f"{c}__{p}": V.date_part(V.parse_timestamp(q(c), types[c]), p) for c, parts in dates.items() for p in parts
        }
        df = df.withColumns(parts_of).select(*[q(c) for c in df.columns if c not in dates], *[q(n) for n in parts_of])
    return df


def merge_labels(df: DataFrame, target: str, merges: Mapping[str, Sequence[str]]) -> DataFrame:
    """Write the variants of a target label as the label itself (compared as trimmed text)."""
    label = q(target)
    out = label
    for into, variants in merges.items():
        out = F.when(V.text(label).isin([v for v in variants if v != into]), F.lit(into).cast(df.schema[target].dataType)
                     ).otherwise(out)
    return df.withColumn(target, out)


def merged_rows(df: DataFrame, target: str, merges: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per kept label, how many rows change."""
    sums = [F.count_if(V.text(q(target)).isin([v for v in vs if v != into])).alias(f"m{i}")
            for i, (into, vs) in enumerate(merges.items())]
    pairs = F.array(*[F.struct(F.lit(into).alias("label"), F.col(f"m{i}").alias("rows_changed"))
                      for i, into in enumerate(merges)])
    return df.agg(*sums).select(F.inline(pairs))
