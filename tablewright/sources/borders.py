"""Records that are not lines, read by many tasks from one file.

A file is read in splits, and a split does not show whether it begins inside a quoted field or deep in a JSON document.
So it is gone through twice:

1. Every split is scanned once for each way it may begin. What it sends is one small row: how it would end.
2. From the first split of a file on, the ends tell how each split truly begins. This is one step per split,
   over a list as long as the list of splits that the driver holds for any scan.
3. Every split is scanned again from its true beginning and cut into records. The piece before its first border
   belongs to the record that an earlier split left open; such pieces meet by that split.

The splits of the second pass must be those of the first; a split that is not known is an error, never a wrong row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.kinds import q
from tablewright.session import written

WHOLE, PIECE, STRAY = 0, 1, 2
_FLUSH_BYTES = 8_000_000  # of records in one batch
_QUOTE, _BACKSLASH, _NEWLINE = 0x22, 0x5C, 0x0A


class Format(Protocol):
    """How a kind of file is scanned. A state is what must be known at a place to go on from there."""

    separator: str  # what the scan splits pieces at; no state is unknown right after it but those in ``guesses``
    junk: bytes  # characters between records
    edge: bytes  # further characters that may stand before the first and after the last record
    first: Any  # the state at the start of a file

    @property
    def guesses(self) -> Sequence[Any]: ...
    def scan(self, data: np.ndarray, state: Any) -> tuple[np.ndarray, Any]: ...
    def summary(self, chunks: Sequence[np.ndarray], before: list | None) -> list: ...
    def follow(self, state: Any, summary: list) -> tuple[Any, bool]: ...
    def open(self, state: Any) -> bool: ...


class QuotedText:
    """Delimited text whose quoted fields may hold line breaks. The state is whether a quoted field is open.

    A quote opens a field only where the field begins; inside, two quotes are one character, and a single one
    closes. Other quotes are plain characters.
    """

    separator, junk, edge, first = "\n", b"\r\n", b"", False

    def __init__(self, delimiter: str):
        self.before = np.zeros(256, bool)  # bytes after which a field begins
        self.before[[ord(delimiter), _NEWLINE, 0x0D]] = True

    @property
    def guesses(self) -> Sequence[bool]:
        return False, True

    def _flips(self, data: np.ndarray, inside: bool) -> np.ndarray:
        """Places of the quotes that open or close a field."""
        at = np.flatnonzero(data == _QUOTE)
        if not len(at):
            return at
        begins = np.empty(len(at), bool)
        begins[0] = at[0] == 0 or self.before[data[at[0] - 1]]
        begins[1:] = self.before[data[at[1:] - 1]]
        # Well-formed text: quotes open and close in turn, and one that opens stands at a field's start or doubles the one before.
        opening = np.arange(len(at)) % 2 == (1 if inside else 0)
        doubled = np.zeros(len(at), bool)
        doubled[1:] = at[1:] == at[:-1] + 1
        if (begins | doubled)[opening].all():
            return at
        flips, i, places = [], 0, at.tolist()
        while i < len(places):
            if not inside:
                if begins[i]:
                    flips.append(places[i])
                    inside = True
            elif i + 1 < len(places) and places[i + 1] == places[i] + 1:
                i += 1
            else:
                flips.append(places[i])
                inside = False
            i += 1
        return np.array(flips, np.int64)

    def scan(self, data: np.ndarray, state: bool) -> tuple[np.ndarray, bool]:
        """Where records end (the place after), and the state at the end."""
        flips = self._flips(data, state)
        breaks = np.flatnonzero(data == _NEWLINE)
        inside = (np.searchsorted(flips, breaks) + state) % 2 == 1
        return breaks[~inside] + 1, bool((len(flips) + state) % 2)

    def summary(self, data: np.ndarray, before: list | None) -> list:
        """For each guess: the state at the end, and whether a record ended on the way."""
        out = []
        for guess, (state, ended) in zip(self.guesses, before or [(g, False) for g in self.guesses]):
            ends, state = self.scan(data, state)
            out.append((state, ended or len(ends) > 0))
        return out

    def follow(self, state: bool, summary: list) -> tuple[bool, bool]:
        after, ended = summary[int(state)]
        return bool(after), bool(ended)

    def open(self, state: bool) -> bool:
        return state


class JsonList:
    """A JSON document that is one list of objects. The state is whether a string is open, and the depth of brackets.

    Pieces end at closing braces; the brace is put back after every piece, also after the last of the file.
    """

    separator, junk, edge, first = "}", b", \t\r\n", b"[]}", (False, 0)
    RECORD = 2  # the depth inside a record

    @property
    def guesses(self) -> Sequence[bool]:
        return False, True

    def _walk(self, data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
        """Places of brackets outside strings, the change of depth up to each, and whether a string is open at the end."""
        quotes = np.flatnonzero(data == _QUOTE)
        slashes = data == _BACKSLASH
        if slashes.any() and len(quotes):
            spots = np.arange(len(data))
            plain = np.maximum.accumulate(np.where(slashes, -1, spots))  # the last byte that is no backslash
            earlier = np.where(quotes > 0, plain[quotes - 1], -1)
            quotes = quotes[(quotes - 1 - earlier) % 2 == 0]
        low = data | 0x20  # both brackets of a kind differ from both braces by one bit
        brackets = np.flatnonzero((low == 0x7B) | (low == 0x7D))
        brackets = brackets[(np.searchsorted(quotes, brackets) + inside) % 2 == 0]
        step = np.where((data[brackets] | 0x20) == 0x7B, 1, -1)
        return brackets, np.cumsum(step), bool((len(quotes) + inside) % 2)

    def scan(self, data: np.ndarray, state: tuple[bool, int]) -> tuple[np.ndarray, tuple[bool, int]]:
        inside, depth = state
        brackets, level, inside = self._walk(data, inside)
        level = level + depth
        before = np.concatenate([[depth], level[:-1]]) if len(level) else level
        ends = brackets[(level == self.RECORD - 1) & (before == self.RECORD)] + 1
        return ends, (inside, int(level[-1]) if len(level) else depth)

    def summary(self, data: np.ndarray, before: list | None) -> list:
        """For each guess: whether a string is open at the end, the change of depth, and the lowest point on the way."""
        out = []
        for inside, depth, lowest in before or [(g, 0, 0) for g in self.guesses]:
            _, level, inside = self._walk(data, inside)
            out.append((inside, depth + (int(level[-1]) if len(level) else 0), min(lowest, depth + (int(level.min()) if len(level) else 0))))
        return out

    def follow(self, state: tuple[bool, int], summary: list) -> tuple[tuple[bool, int], bool]:
        inside, depth = state
        after, change, lowest = summary[int(inside)]
        return (bool(after), depth + change), depth + lowest < self.RECORD

    def open(self, state: tuple[bool, int]) -> bool:
        return state[1] >= self.RECORD


def _pieces(spark: SparkSession, paths, form: Format) -> DataFrame:
    """What stands between separators, with its file and split and, where folders name some, the partition columns."""
    rows = spark.read.text(paths, lineSep=form.separator)
    return rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__split")) \
        .withColumn("value", F.col("value").cast("binary"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The batch by file and split, which follow each other."""
    if not batch.num_rows:
        return
    files, splits = batch.column("__file").dictionary_encode(), batch.column("__split").to_numpy()
    codes = files.indices.to_numpy()
    edges = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (splits[1:] != splits[:-1]), [True]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield files.dictionary[int(codes[a])].as_py(), int(splits[a]), batch.slice(a, b - a)


def _data(batch: pa.RecordBatch, form: Format, start: bool) -> np.ndarray:
    sep = form.separator.encode()
    data = sep.join(batch.column("value").to_pylist()) + sep
    if start and data.startswith(b"\xef\xbb\xbf"):
        data = data[3:]
    return np.frombuffer(data, np.uint8)


def _summaries(form: Format):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key, found):
            flat = [[int(v) for v in one] for one in found]
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([flat], pa.list_(pa.list_(pa.int64())))], ["file", "split", "found"])
        key, found = None, None
        for batch in batches:
            for file, split, rows in _runs(batch):
                start = (file, split) != key
                if start and key is not None:
                    yield row(key, found)
                    found = None
                key = (file, split)
                found = form.summary(_data(rows, form, start and split == 0), found)
        if key is not None:
            yield row(key, found)
    return run


def beginnings(pieces: DataFrame, form: Format) -> tuple[dict[tuple[str, int], tuple[Any, int]], dict[str, Any]]:
    """How every split begins and which earlier split left its first record open, and the state at the end of every file."""
    rows = pieces.select("value", "__file", "__split").mapInArrow(_summaries(form), "file string, split bigint, found array<array<bigint>>")
    known, last = {}, {}
    state, owner, current = form.first, -1, None
    for r in sorted(rows.collect(), key=lambda r: (r["file"], r["split"])):  # one row per split, like the scan's own list
        if r["file"] != current:
            state, owner, current = form.first, -1, r["file"]
        opened = form.open(state)
        known[(r["file"], r["split"])] = (state, owner if opened else -1)
        state, ended = form.follow(state, r["found"])
        if form.open(state) and (ended or not opened):
            owner = r["split"]
        last[current] = state
    return known, last


def _cut(form: Format, shared, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        out: list[tuple] = []
        size = 0

        def flush(rows: pa.RecordBatch) -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
            fixed = [pa.array(c, k) for c, k in zip(columns, kinds)]
            same = [pa.array([rows.column(c)[0].as_py()] * len(out), rows.schema.field(c).type) for c in extra]
            out.clear()
            return pa.RecordBatch.from_arrays(fixed + same, ["file", "split", "owner", "kind", "head", "record", *extra])

        key, state, owner, rest, head, last = None, None, -1, [], False, None

        def end_of_split():
            """What is left open goes on in the next split; anything else between records is stray."""
            left = b"".join(rest)
            if form.open(state) and left.strip(form.junk):
                out.append((key[0], key[1], owner if owner >= 0 else key[1], PIECE, head, left))
            elif left.strip(form.junk + form.edge):
                out.append((key[0], key[1], -1, STRAY, False, left))

        for batch in batches:
            for file, split, rows in _runs(batch):
                start = (file, split) != key
                if start:
                    if key is not None:
                        end_of_split()
                        yield flush(last)
                        size = 0
                    key, rest = (file, split), []
                    if key not in known:
                        raise RuntimeError(f"{file} was split differently when it was read again; read it once more")
                    state, owner = known[key]
                    head = split == 0
                last = rows
                values = _data(rows, form, start and split == 0)
                ends, state = form.scan(values, state)
                data, begin = values.tobytes(), 0
                for end in ends.tolist():
                    record = data[begin:end]
                    if rest:
                        record = b"".join(rest) + record
                        rest = []
                    begin = end
                    if owner >= 0 or record.strip(form.junk):
                        out.append((file, split, owner, PIECE if owner >= 0 else WHOLE, head, record))
                        size += len(record)
                        head, owner = False, -1
                if begin < len(data):
                    rest.append(data[begin:])
                if size > _FLUSH_BYTES:
                    yield flush(rows)
                    size = 0
        if key is not None:
            end_of_split()
            yield flush(last)
    return run


def records(spark: SparkSession, paths, form: Format) -> tuple[DataFrame, dict[str, Any], bool]:
    """``(file, head, record)`` with the partition columns, written once; the state at the end of each file; whether anything
    stands outside records that may not stand there.

    ``record`` is the bytes of a record with what stands before and after it; ``head`` marks the first of a file, which
    begins in its first split. Records without any content are left out.
    """
    pieces = _pieces(spark, paths, form)
    known, last = beginnings(pieces, form)
    extra = [c for c in pieces.columns if c not in ("value", "__file", "__split")]
    kinds = "".join(f", `{c}` {pieces.schema[c].dataType.simpleString()}" for c in extra)
    shared = spark.sparkContext.broadcast(known)
    cut = written(pieces.mapInArrow(_cut(form, shared, extra), "file string, split bigint, owner bigint, kind int, head boolean, record binary" + kinds), "records")
    others = [q(c) for c in extra]
    whole = cut.where(F.col("kind") == WHOLE).select("file", "head", "record", *others)
    # At most two pieces per split.
    parts = F.sort_array(F.collect_list(F.struct("split", "record")))
    joined = cut.where(F.col("kind") == PIECE).groupBy("file", "owner", *others).agg(F.max("head").alias("head"), parts.alias("parts"))
    joined = joined.select("file", "head", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["record"])), "")).alias("record"), *others)
    return whole.unionAll(joined), last, not cut.where(F.col("kind") == STRAY).isEmpty()
