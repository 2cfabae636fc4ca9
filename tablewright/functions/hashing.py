"""Reproducible pseudo-random numbers from row keys, the same on every engine and run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.kinds import as_text, q

HASH_DIGITS = 32


def row_hash(keys: Sequence[str], seed: int) -> Column:
    """128 bits, as hex text, from the seed and the key columns (``seed:k1:k2``).

    Fixed-length hex sorts like the number it writes, so it is compared as it is.
    """
    parts = [F.lit(str(seed))] + [F.coalesce(q(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def fold_edges(folds: int) -> list[str]:
    """Where the range of an eight-digit hex number is cut into equal parts."""
    return [format(i * 16 ** 8 // folds, "08x") for i in range(1, folds)]


def hash_fold(keys: Sequence[str], seed: int, folds: int) -> Column:
    """A fold number from 0, by range of the hash."""
    h = F.substring(row_hash(keys, seed), 1, 8)
    first, *rest = fold_edges(folds)
    return sum(((h >= e).cast("int") for e in rest), (h >= first).cast("int"))


def default_key(df: DataFrame, key: Sequence[str] | None) -> list[str]:
    """The given key, or every column: equal rows then share a fold, so copies never straddle a split."""
    return list(key) if key else list(df.columns)


def digest(df: DataFrame, names: Sequence[str]) -> Column:
    """128 bits over whole rows: each value with its length in front, NULL without, so that no two rows read alike."""
    # -0.0 equals 0.0, though their texts differ.
    zero = {n: q(n) + F.lit(0.0) for n in names if dict(df.dtypes)[n] in ("float", "double")}
    texts = [zero[n].cast("string") if n in zero else c for n, c in zip(names, as_text(df, names))]
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("n")) for c in texts]
    return F.md5(F.concat(*parts) if parts else F.lit(""))
