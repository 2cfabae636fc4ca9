"""Stretches of a text that repeat with a period, found through a dictionary of basic factors.

Words are numbered. At level k every place names the factor of 2 ** k words that starts there, and equal
factors have equal names; a name is the pair of names of the factor's halves. Factors that occur once in
the text cannot grow into others that repeat, so only places whose factor occurs again go on to the next level.

At each level a place's successor is the next place with its name. Where successors within twice the
length stand a constant step apart, they form an arithmetic progression, and its step is proposed as a period:
neighbouring places of one step join to a stretch that has this period. A proposal that is long enough is
extended word by word, and the same run, which several levels propose, is kept once. The nearest
successor gives the smallest period, and a run of period q with 4 q words is proposed whole at the level
whose length is the first that is not below q (by the periodicity lemma of Fine and Wilf).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.text import whole

# Fixed values of the contract.
LEAST_WORDS, LEAST_PERIODS = 6, 4
FOLD = 10  # one document in ten is planted with a repeating tail


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _named(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Numbers from 0 for pairs of numbers, equal for equal pairs."""
    pair = first * (int(second.max(initial=0)) + 1) + second
    return np.unique(pair, return_inverse=True)[1]


def _extended(names: np.ndarray, start: int, stop: int, period: int) -> tuple[int, int]:
    """The longest stretch around ``start`` to ``stop`` that keeps the period, compared in blocks that double."""
    block = 16
    while start:
        low = max(0, start - block)
        differs = np.flatnonzero(names[low:start] != names[low + period:start + period])
        if len(differs):
            start = low + int(differs[-1]) + 1
            break
        start, block = low, 2 * block
    block = 16
    while stop < len(names):
        high = min(len(names), stop + block)
        differs = np.flatnonzero(names[stop:high] != names[stop - period:high - period])
        if len(differs):
            stop += int(differs[0])
            break
        stop, block = high, 2 * block
    return start, stop


def find_runs(names: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of at least ``least`` words and ``periods`` periods, by start, then period.

    A run is a stretch whose smallest period is ``period`` and which no neighbouring word extends.
    ``periods`` is 4 or more, or the levels would not see every run whole.
    """
    n, length = len(names), 1
    found: set[tuple[int, int, int]] = set()
    at, name = np.arange(n), names  # places whose factor of this length may repeat, and its name
    while len(at) and length < n:
        order = np.argsort(name, kind="stable")
        place, label = at[order], name[order]
        same = label[1:] == label[:-1]
        step = np.zeros(n + 1, np.int64)  # of each place to its successor, 0 without one within reach
        gap = place[1:] - place[:-1]
        near = same & (gap <= 2 * length)
        step[place[:-1][near]] = gap[near]
        # Neighbouring places with one step: a stretch with that period.
        edges = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]]))
        begin, end, period = edges[:-1], edges[1:], step[edges[:-1]]
        size = end - begin + period + length - 1
        for s, z, p in zip(*(c[(period > 0) & (size >= np.maximum(least, periods * period))].tolist() for c in (begin, size, period))):
            a, b = _extended(names, s, s + z, p)
            found.add((a, b - a, p))
        # Places whose factor occurs more than once, and the names of twice the length.
        if 4 * length > n:  # a longer factor has no period that fits four times
            break
        again = np.zeros(len(place), bool)
        again[1:] |= same
        again[:-1] |= same
        names_here = np.full(n, -1, np.int64)
        names_here[place[again]] = label[again]
        at = np.sort(place[again])
        at = at[at + 2 * length <= n]
        at = at[names_here[at + length] >= 0]
        name = _named(names_here[at], names_here[at + length])
        length *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that stay when every run keeps its first period only."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, kept = [], []
        for value in batch.column("__text").cast(pa.large_binary()):
            words = (value.as_py() or b"").split()  # at the contract's white space, which is that of bytes
            runs = find_runs(numbered(words))
            found.append([{"start": s, "length": z, "period": p} for s, z, p in runs])
            kept.append(b" ".join(collapsed(words, runs)).decode())
        rest = [i for i, n in enumerate(batch.schema.names) if n != "__text"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in rest], pa.array(found, pa.list_(_RUN)), pa.array(kept, pa.string())],
            [*[batch.schema.names[i] for i in rest], "runs", "collapsed"])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (an array of start, length and period, in words) and ``collapsed``, the text without repeats.

    A run has its smallest period at least four times and six words at least; a word goes when a run holds it
    after that run's first period. The words that stay are joined by one space. A null or empty text has no
    words, no runs and an empty result. Every row stands for itself, so repeated rows and null keys need no
    rule, an empty table gives no rows, and columns of ``docs`` with one of the two names are replaced. Names that
    begin with two underscores are left out. A row is handled where it is read: nothing is shuffled.
    """
    given = [f for f in docs.schema.fields if f.name not in ("runs", "collapsed") and not f.name.startswith("__")]
    columns = [F.col(f"`{f.name}`") for f in given]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given)
    return docs.select(*columns, whole(F.col(f"`{text}`")).alias("__text")).mapInArrow(
        _scan, schema + "runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(text: Column, key: Column) -> Column:
    """The text, in one of ten documents with a tail that repeats, as the hash of the document's key decides."""
    words = F.filter(F.split(whole(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / FOLD)

    def tail(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1)).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = F.sequence(F.lit(0).cast("bigint"), n - 1)
        return F.concat_ws(" ", F.transform(place, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))))

    repeated = F.element_at(F.transform(F.array(words), tail), 1)
    return F.when(key.isNotNull() & (h % FOLD == 0) & (F.size(words) > 0), repeated).otherwise(whole(text))


def longest(runs: Column) -> Column:
    """The run with the greatest length in periods (exactly), of equals the first, then the smallest period; null without any."""
    def better(best: Column, run: Column) -> Column:
        a, b = run["length"] * best["period"], best["length"] * run["period"]
        first = (run["start"] < best["start"]) | ((run["start"] == best["start"]) & (run["period"] < best["period"]))
        return F.when(best.isNull() | (a > b) | ((a == b) & first), run).otherwise(best)
    kind = "struct<start: bigint, length: bigint, period: bigint>"
    return F.aggregate(runs, F.lit(None).cast(kind), better)


def digest(runs: Column) -> Column:
    """SHA-256 of all runs, one ``start,length,period`` a line."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return F.sha2(F.concat_ws("", lines), 256)
