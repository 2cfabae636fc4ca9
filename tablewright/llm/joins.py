"""Joins whose small side is counted first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000  # keys or hashes of some 24 bytes


def counted(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of keys as one side of a join: to every task if it has at most ``most`` rows, else by key."""
    return F.broadcast(table) if table.count() <= most else table
