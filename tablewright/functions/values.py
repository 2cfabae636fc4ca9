"""Value rules shared by cleaning, audit and scoring. All are plain Column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.kinds import kind

# How a number may be written, what is ignored around one in text,
# and the tokens that a delimited file uses for "missing".
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
NUMBER_DECORATION = r"[,\s$€£%]"
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Date formats, each with the shape a value must have before it is parsed at all.
DATE_FORMATS = {
    "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$",
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$",
    "yyyy-MM-dd HH:mm:ss.SSSSSS": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{6}$",
    "yyyy-MM-dd'T'HH:mm:ss": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$",
    "yyyy/MM/dd": r"^\d{4}/\d{2}/\d{2}$",
    "MM/dd/yyyy": r"^\d{2}/\d{2}/\d{4}$",
    "MM/dd/yyyy HH:mm:ss": r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$",
    "dd MMM yyyy": r"^\d{2} [A-Z][a-z]{2} \d{4}$",
    "MMM dd, yyyy": r"^[A-Z][a-z]{2} \d{2}, \d{4}$",
    "yyyyMMdd": r"^\d{8}$",
}
DATE_PARTS = ("year", "month", "day", "day_of_week", "hour")


def number_text(value: Column) -> Column:
    """Text as a double where it is written as a number, else NULL.

    The pattern guard matters: a bare cast also accepts ``7d`` and ``NaN``.
    """
    return F.when(value.rlike(NUMBER_PATTERN), F.trim(value).try_cast("double"))


def number(value: Column, data_type: T.DataType) -> Column:
    """Any column read as a double; NaN and infinities are missing."""
    k = kind(data_type)
    if k == "text":
        return number_text(value)
    if k in ("numeric", "boolean"):
        return finite(value.cast("double"))
    return F.lit(None).cast("double")


def finite(value: Column) -> Column:
    """A double, with NaN and the infinities as NULL."""
    return F.when(F.abs(value) < F.lit(math.inf), value)


def text(value: Column) -> Column:
    return F.trim(value.cast("string"))


def _as_float(code: object) -> float | None:
    try:
        value = float(code)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    return value if math.isfinite(value) else None


def is_code(value: Column, data_type: T.DataType, codes: Iterable[object]) -> Column:
    """Where a value is one of the codes: equal as numbers, or equal as trimmed text."""
    codes = list(codes)
    hit = text(value).isin([str(c).strip() for c in codes])
    numbers = [n for n in map(_as_float, codes) if n is not None]
    if numbers:
        hit = hit | F.coalesce(number(value, data_type).isin(numbers), F.lit(False))
    return F.coalesce(hit, F.lit(False))


def code_label(value: Column, data_type: T.DataType) -> Column:
    """A code as a category label: 7, 7.0 and "7" are all "7"."""
    as_number = number(value, data_type)
    whole = as_number == F.floor(as_number)
    return (
        F.when(whole, as_number.cast("decimal(38,0)").cast("string"))
        .when(as_number.isNotNull(), as_number.cast("string"))
        .otherwise(text(value))
    )


def parse_timestamp(value: Column, data_type: T.DataType, formats: Mapping[str, str] = DATE_FORMATS) -> Column:
    """Text as a timestamp by the first format that fits; NULL where none does.

    A value is parsed only by formats whose shape it has: a failed parse raises inside
    the parser, which costs far more than the test of the shape.
    """
    if kind(data_type) == "temporal":
        return value
    trimmed = text(value)
    return F.coalesce(*[
        F.when(trimmed.rlike(shape), F.try_to_timestamp(trimmed, F.lit(f)).cast("timestamp_ntz"))
        for f, shape in formats.items()
    ])


def date_part(stamp: Column, part: str) -> Column:
    """One calendar part as a double; Monday is day 0 of the week."""
    readers = {
        "year": F.year, "month": F.month, "day": F.dayofmonth, "day_of_week": F.weekday, "hour": F.hour,
    }
    return readers[part](stamp).cast("double")


def pct(part: Column, whole: Column) -> Column:
    """A percentage with two decimals; 0 where there is nothing to divide by."""
    return F.coalesce(F.round(F.try_divide(100.0 * part, whole), 2), F.lit(0.0))
