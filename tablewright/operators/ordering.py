"""Order-based operators that never put a whole table in one task.

Ranks and running totals use a plain window while the input is known to be small.
Above that the rows are range-partitioned, each range is numbered on its own, and
the small table of range totals supplies the offset of every range.

Exact quantiles use the native aggregate while the input is known to be small.
Above that a sketch brackets every wanted rank, the bracket is counted exactly,
and the search repeats inside the bracket until only a handful of values is left.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.kinds import q
from tablewright.session import written

SMALL_ROWS = 1_000_000
BRACKET_VALUES = 500_000  # values that one task ranks
MOST_OFFSETS = 500_000
GRID = 2_000  # steps of a sketch, wider than its error
_SKETCH_ACCURACY = 10_000


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    sums: Mapping[str, Column],
    within: Sequence[str] = (),
    rows: int | None = None,
    small: int = SMALL_ROWS,
) -> DataFrame:
    """Add a running total (this row included) per entry of ``sums``.

    ``order`` must be unique inside each ``within`` group: aggregate by the order
    value first, so that a heavy value is one row. ``rows`` is an upper bound on
    the size of ``df`` when the caller knows one; otherwise the rows are counted.
    """
    groups = [q(c) for c in within]
    rows = df.count() if rows is None else rows
    if rows <= small:
        frame = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(value).over(frame) for name, value in sums.items()})

    ranges = math.ceil(rows / small) * 2
    values = {f"__v{i}": value for i, value in enumerate(sums.values())}
    ranged = df.withColumns(values).repartitionByRange(ranges, *groups, *order)
    # Written once: the range borders come from a sample and must not be drawn again.
    ranged = written(ranged.withColumn("__range", F.spark_partition_id()), "ranges")
    frame = Window.partitionBy("__range", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({name: F.sum(v).over(frame) for name, v in zip(sums, values)})

    # At most one row per range and group: bounded by rows / small plus the groups.
    totals = ranged.groupBy("__range", *groups).agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("__range").alias("__r"),
        *[g.alias(f"__g{i}") for i, g in enumerate(groups)],
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"__o{i}") for i, v in enumerate(values)],
    )
    match = F.col("__range") == F.col("__r")
    for i, g in enumerate(groups):
        match = match & g.eqNullSafe(F.col(f"__g{i}"))
    if totals.count() <= MOST_OFFSETS:
        offsets = F.broadcast(offsets)  # the rows do not move again
    joined = local.join(offsets, match)
    return joined.select(
        *[q(c) for c in df.columns],
        *[(F.col(name) + F.col(f"__o{i}")).alias(name) for i, name in enumerate(sums)],
    )


def position(
    df: DataFrame, order: Sequence[Column], name: str, within: Sequence[str] = (), rows: int | None = None,
    small: int = SMALL_ROWS,
) -> DataFrame:
    """Number the rows from 1 in the given (unique) order."""
    return running_totals(df, order, {name: F.lit(1).cast("bigint")}, within, rows, small)


@dataclass
class _Interval:
    """Values from ``low`` to ``high`` (all without borders) that hold wanted ranks: rows below them, rows inside."""

    low: float | None
    high: float | None
    below: int
    rows: int
    ranks: list[int]


def _place(value: Column, marks: Sequence[float], leaf: Callable[[int], Column]) -> Column:
    """``leaf`` of the number of marks below the value, found by halving."""
    def search(first: int, last: int) -> Column:
        if first == last:
            return leaf(first)
        middle = (first + last) // 2
        return F.when(value > F.lit(marks[middle]), search(middle + 1, last)).otherwise(search(first, middle))
    return search(0, len(marks))


def _inside(df: DataFrame, intervals: Mapping[str, Sequence[_Interval]]) -> DataFrame:
    """``(request, value)`` of every row and column whose value is in an interval; requests count the intervals in order."""
    cells, first = [], 0
    for c, own in intervals.items():
        value = q(c).cast("double")

        def request(i: int, own=own, value=value, first=first) -> Column:
            if i == len(own):
                return F.lit(None).cast("int")
            return F.lit(first) + i if own[i].low is None else F.when(value >= F.lit(own[i].low), F.lit(first + i))
        highs = [interval.high for interval in own if interval.high is not None]  # one without a border is alone
        cells.append(F.struct(_place(value, highs, request).alias("request"), value.alias("value")))
        first += len(own)
    return df.select(F.inline(F.array(*cells))).filter("request IS NOT NULL AND value IS NOT NULL")


def _sketches(df: DataFrame, intervals: Mapping[str, Sequence[_Interval]]) -> list[tuple[int, list[float]]]:
    """For each interval about how many different values it has, and its values at equal steps of rank."""
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])

    def sketch(value: Column) -> tuple[Column, Column]:
        return F.approx_count_distinct(value, 0.05).alias("d"), F.percentile_approx(value, grid, _SKETCH_ACCURACY).alias("m")
    if all(i.low is None and i.high is None for own in intervals.values() for i in own):  # whole columns
        row = df.agg(*[F.struct(*sketch(q(c).cast("double"))) for c in intervals]).first()
        return [(r["d"], r["m"]) for r in row]
    found = {r["request"]: r for r in _inside(df, intervals).groupBy("request").agg(*sketch(F.col("value"))).collect()}
    return [(found[i]["d"], found[i]["m"]) for i in range(sum(map(len, intervals.values())))]


def _counts_at(df: DataFrame, borders: Mapping[str, Sequence[float]]) -> dict[tuple[str, float], tuple[int, int]]:
    """Rows below each border of a column, and rows up to it."""
    def step(c: str, own: Sequence[float]) -> Column:
        value = q(c).cast("double")
        return _place(value, own, lambda p: F.lit(2 * p) if p == len(own) else F.when(value == F.lit(own[p]), 2 * p + 1).otherwise(2 * p))
    cells = [F.struct(F.lit(i).alias("c"), F.when(q(c).isNotNull(), step(c, own)).alias("step")) for i, (c, own) in enumerate(borders.items())]
    steps = df.select(F.inline(F.array(*cells))).filter("step IS NOT NULL").groupBy("c", "step").count().collect()
    out = {}
    for i, (c, own) in enumerate(borders.items()):
        at = [0] * (2 * len(own) + 1)
        for r in steps:
            if r["c"] == i:
                at[r["step"]] = r["count"]
        upto = list(accumulate(at))
        out.update({(c, v): (upto[2 * p], upto[2 * p + 1]) for p, v in enumerate(own)})
    return out


def order_statistics(
    df: DataFrame, wanted: Mapping[str, Sequence[int]], counts: Mapping[str, int],
    bracket_values: int = BRACKET_VALUES,
) -> dict[tuple[str, int], float]:
    """The k-th smallest value (k from 0) of each column, exactly, by narrowing brackets.

    A column of few values is counted by value at once. Of the others one sketch each gives a bracket for every rank, one
    pass counts the rows between all borders, and what is left inside the brackets is counted by value. A pass costs
    one step by halving per row and column, however many ranks are wanted; a bracket that still
    holds too many rows is narrowed again, by some 700 times.
    """
    found: dict[tuple[str, int], float] = {}
    ready: dict[str, list[_Interval]] = {}
    open_ = {c: [_Interval(None, None, 0, counts[c], sorted(set(ranks)))] for c, ranks in wanted.items() if counts[c] and ranks}
    while open_:
        sketches = iter(_sketches(df, open_))
        narrowed: list[tuple[str, _Interval, int, float, float]] = []
        for c, own in open_.items():
            for interval in own:
                distinct, marks = next(sketches)
                if min(distinct, interval.rows) <= bracket_values:
                    ready.setdefault(c, []).append(interval)
                    continue
                for k in interval.ranks:
                    at = (k - interval.below) / max(interval.rows - 1, 1) * GRID
                    narrowed.append((c, interval, k, marks[max(0, math.floor(at) - 1)], marks[min(GRID, math.ceil(at) + 1)]))
        if not narrowed:
            break
        borders: dict[str, set[float]] = {}
        for c, _, _, low, high in narrowed:
            borders.setdefault(c, set()).update((low, high))
        counted = _counts_at(df, {c: sorted(own, key=_spark_order) for c, own in borders.items()})
        open_ = {}
        last: tuple[str, _Interval] | None = None
        for c, parent, k, low, high in narrowed:  # in rising order of the ranks, column by column
            below, upto = counted[(c, low)][0], counted[(c, high)][1]
            if not below <= k:  # the sketch was off: keep the old border
                low, below = parent.low, parent.below
            if not k < upto:
                high, upto = parent.high, parent.below + parent.rows
            if low is not None and low == high:
                found[(c, k)] = low
            elif last and last[0] == c and below < last[1].below + last[1].rows:  # meets the bracket before it
                before = last[1]
                if upto > before.below + before.rows:
                    before.high, before.rows = high, upto - before.below
                if below < before.below:
                    before.low, before.rows, before.below = low, before.below + before.rows - below, below
                before.ranks.append(k)
            else:
                last = (c, _Interval(low, high, below, upto - below, [k]))
                open_.setdefault(c, []).append(last[1])
        sizes = {c: max(i.rows for p, i, *_ in narrowed if p == c) for c in open_}
        for c, own in list(open_.items()):
            few = [i for i in own if i.rows <= bracket_values or i.rows >= sizes[c]]  # counted by value, or no narrower than before
            ready.setdefault(c, []).extend(few)
            open_[c] = [i for i in own if i not in few]
            if not open_[c]:
                del open_[c]

    ready = {c: sorted(own, key=lambda i: i.below) for c, own in ready.items() if own}
    if ready:
        requests = [(c, interval) for c, own in ready.items() for interval in own]
        values = _inside(df, ready).groupBy("request", "value").count()
        rank = Window.partitionBy("request").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        ranks = F.element_at(
            F.array(*[F.array(*[F.lit(k - i.below).cast("bigint") for k in i.ranks]) for _, i in requests]), F.col("request") + 1)
        upto = values.withColumn("upto", F.sum("count").over(rank))
        hits = upto.select("request", "value", F.filter(
            ranks, lambda k: (F.col("upto") - F.col("count") <= k) & (k < F.col("upto"))).alias("hits")).filter(F.size("hits") > 0)
        for row in hits.collect():  # at most one row per wanted rank
            c, interval = requests[row["request"]]
            found.update({(c, k + interval.below): row["value"] for k in row["hits"]})
    return found


def _spark_order(value: float) -> tuple[bool, float]:
    """NaN comes after all numbers."""
    return math.isnan(value), 0.0 if math.isnan(value) else value


def quantiles(
    df: DataFrame, columns: Sequence[str], shares: Sequence[float], rows: int | None = None,
    small: int = SMALL_ROWS, bracket_values: int = BRACKET_VALUES,
) -> dict[str, Column]:
    """Per column, an aggregate giving the array of linearly interpolated quantiles."""
    rows = df.count() if rows is None else rows
    if rows <= small or not columns:
        marks = F.array(*[F.lit(float(s)) for s in shares])
        return {c: F.percentile(q(c).cast("double"), marks) for c in columns}
    counted = df.agg(*[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    counts = {c: counted[f"n{i}"] for i, c in enumerate(columns)}
    spots = {c: [s * (counts[c] - 1) for s in shares] for c in columns if counts[c]}
    wanted = {c: [r for s in at for r in (math.floor(s), math.ceil(s))] for c, at in spots.items()}
    values = order_statistics(df, wanted, counts, bracket_values)
    out = {}
    for c in columns:
        marks = []
        for s in spots.get(c, []):
            low, high = values[(c, math.floor(s))], values[(c, math.ceil(s))]
            marks.append(low + (s - math.floor(s)) * (high - low))
        out[c] = F.array(*[F.lit(m) for m in marks]) if marks else F.lit(None).cast("array<double>")
    return out
