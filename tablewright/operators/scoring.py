"""Scoring new rows with a saved bundle: raw columns in, labels and probabilities out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import values as V
from tablewright.functions.kinds import q
from tablewright.operators import models
from tablewright.operators.cleaning import CleaningSpec, prepare


class MissingInputs(ValueError):
    """The table lacks columns the model needs; the message lists them."""


@dataclass
class Bundle:
    """A model with the cleaning that its inputs go through and the raw columns they come from."""

    fitted: models.Fitted
    spec: CleaningSpec
    inputs: list[tuple[str, str]]  # raw column and its type

    def save(self, path: str) -> None:
        self.fitted.extra.update(spec=self.spec.to_json(), inputs=self.inputs)
        models.save(self.fitted, path)

    @staticmethod
    def load(path: str) -> "Bundle":
        fitted = models.load(path)
        spec = CleaningSpec.from_json(fitted.extra["spec"])
        return Bundle(fitted, spec, [tuple(i) for i in fitted.extra["inputs"]])


def inputs_of(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, str]]:
    return [(c, df.schema[c].dataType.simpleString()) for c in columns]


def score(df: DataFrame, bundle: Bundle) -> DataFrame:
    """The input columns plus ``prediction`` and, for classes, ``probability_<label>``.

    Cleaning, encoding and prediction are projections over the input, so the job has no shuffle
    (except for a neighbour model or an encoder with a joined level table).
    """
    needed = [c for c, _ in bundle.inputs]
    absent = [c for c in needed if c not in df.columns]
    if absent:
        raise MissingInputs(f"The input is missing columns: {absent}")
    names = [f"__raw{i}" for i in range(len(df.columns))]
    # The raw columns travel along under names that cleaning cannot touch.
    held = df.select(*[q(c).alias(n) for c, n in zip(df.columns, names)], *[q(c) for c in needed])
    scored = bundle.fitted.predict(prepare(held, bundle.spec))
    raw = [q(n).alias(c) for c, n in zip(df.columns, names)]
    labels = bundle.fitted.labels
    if bundle.fitted.task != "classification":
        return scored.select(*raw, "prediction")
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), (q("prediction") + 1).cast("int"))
    shown = [label.alias("prediction")]
    if "probability" in scored.columns:
        shown += [q("probability")[i].alias(f"probability_{x}") for i, x in enumerate(labels)]
    return scored.select(*raw, *shown)


def from_records(df: DataFrame, bundle: Bundle) -> DataFrame:
    """Records by name: inputs that a record does not have are missing values."""
    return df.select(*[
        (q(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in bundle.inputs
    ])


def from_rows(spark: SparkSession, df: DataFrame, bundle: Bundle) -> DataFrame:
    """Rows by position: one column per input, in the model's order."""
    if len(df.columns) != len(bundle.inputs):
        raise MissingInputs(f"Each row must have {len(bundle.inputs)} values, in the order of the input schema.")
    return df.toDF(*[c for c, _ in bundle.inputs]).select(*[q(c).cast(t).alias(c) for c, t in bundle.inputs])


def input_schema(df: DataFrame, columns: Sequence[str], order: Sequence[str], target: str | None = None) -> DataFrame:
    """``(column, dtype, example)``: what a model expects, with the first row as the example."""
    shown = [c for c in columns if c != target]
    first = df.orderBy(*[q(o) for o in order]).limit(1)
    types = dict(df.dtypes)
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), q(c).cast("string").alias("example"))
        for c in shown
    ])
    return first.select(F.inline(cells))


def typed_value(value, data_type: T.DataType = T.StringType()):
    """A value typed into a form: blank is missing, numeric text is a number, the rest is text."""
    blank = F.trim(value) == ""
    number = V.number_text(value)
    return F.struct(
        (value.isNull() | blank).alias("missing"), number.alias("number"),
        F.when(~blank & number.isNull(), value).alias("text"))


def first_rows(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """A preview: the first n rows in row order (a bounded heap per partition, no sort)."""
    return df.orderBy(*[q(o) for o in order]).limit(n)
