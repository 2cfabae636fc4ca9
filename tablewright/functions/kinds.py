"""Column kinds the operators branch on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
_INTERVAL = (T.DayTimeIntervalType, T.YearMonthIntervalType)
_NESTED = (T.StructType, T.ArrayType, T.MapType)


def kind(field: T.StructField | T.DataType) -> str:
    """``numeric``, ``boolean``, ``temporal``, ``interval``, ``nested`` or ``text``."""
    data_type = field.dataType if isinstance(field, T.StructField) else field
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, _TEMPORAL):
        return "temporal"
    if isinstance(data_type, _INTERVAL):
        return "interval"
    if isinstance(data_type, _NESTED):
        return "nested"
    return "text"


def kinds(df: DataFrame) -> dict[str, str]:
    return {field.name: kind(field) for field in df.schema.fields}


def columns_of(df: DataFrame, *wanted: str) -> list[str]:
    """The columns of the given kinds, in table order."""
    return [name for name, k in kinds(df).items() if k in wanted]


def is_integer(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.IntegralType)


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType, T.DecimalType))


def q(name: str) -> Column:
    """A column by its exact name, which may hold dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Every named column as text, so that unlike types fit one value column."""
    fields = {f.name: f for f in df.schema.fields}
    return [
        (F.to_json(q(n)) if kind(fields[n]) == "nested" else q(n).cast("string")).alias(n) for n in names
    ]
