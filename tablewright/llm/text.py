"""Columns that several operators take from a text, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the contracts.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
LETTERS, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole(text: Column) -> Column:
    """The text; a null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def word_count(text: Column) -> Column:
    """Number of words: each becomes one letter, and what is left besides white space is counted."""
    return F.length(without(F.regexp_replace(whole(text), WORD, "w"), SPACES)).cast("bigint")


def unit_hash(seed: int, *keys: Column) -> Column:
    """A number from 0 to below 1 that the seed and the keys decide, with NULL told apart from text."""
    parts = [F.coalesce(F.concat(F.lit("v"), k.cast("string")), F.lit("n")) for k in keys]
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(float(16 ** 13))
