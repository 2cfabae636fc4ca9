"""Best-fit packing of tokenized documents into sequences of a fixed length, in bulk-synchronous rounds."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.tokens import ids_of, vocabulary_path
from tablewright.session import written

CAPACITY, END = 1024, 2  # tokens of a sequence, and the id that closes a document
BROADCAST_RUNS = 200_000


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    def cut(text: str | None) -> Iterator[tuple[int, np.ndarray]]:
        ids = np.append(ids_of(text or "", path), np.uint32(end)).astype("<u4")
        start, stop = 0, len(ids) % capacity or capacity
        while start < len(ids):
            yield start, ids[start:stop]
            start, stop = stop, stop + capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ranks = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows, columns = [], [[] for _ in range(6 + with_ids)]
            for row, text in enumerate(batch.column(1)):
                for number, (start, ids) in enumerate(cut(text.as_py())):
                    rows.append(row)
                    values = [number, start, len(ids), zlib.crc32(ids.tobytes()), task, int(ranks[len(ids)])]
                    ranks[len(ids)] += 1
                    for column, value in zip(columns, [*values, ids] if with_ids else values):
                        column.append(value)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            names = ["piece", "start", "length", "ids_crc32", "__task", "__rank", "ids"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *arrays], ["key", *names[:len(arrays)]])
    return run


def cut_pieces(
    docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str | None = None,
    capacity: int = CAPACITY, end: int = END, with_ids: bool = False,
) -> DataFrame:
    """The pieces of every document, on shared files: a document that is too long is cut so that only its first piece may be shorter.

    ``__task`` and ``__rank`` number the pieces of each length inside the task that wrote them.
    """
    kind = dict(docs.dtypes)[key]
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long, __task int, __rank long"
    run = _pieces(tokenizer or vocabulary_path(), capacity, end, with_ids)
    return written(docs.select(key, text).mapInArrow(run, schema + ", ids array<bigint>" * with_ids), "pieces")


@dataclass(frozen=True)
class Run:
    """The pieces of a length with ranks from first to before last lie in consecutive sequences, all at one offset."""
    length: int
    first: int
    last: int
    sequence: int
    offset: int


def match_rounds(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best fit, from the longest pieces to the shortest, over run-length-coded sorted lists.

    Pieces of equal length are interchangeable, and so are sequences of equal gap; both sorted lists
    are held as runs. A round takes the longest unplaced pieces, sweeps to the successor of their
    length among the gaps (the smallest that holds them), gives each such gap one piece by rank, and
    moves the matched part of the gap run to its new size. It repeats while a gap holds them; what is
    left opens sequences and fills each. The lists have at most ``capacity`` sizes whatever the corpus,
    so the rounds cost the same at every scale; only ranks and places are work on the documents.
    """
    runs: list[Run] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # size: runs of sequences as first and count
    sizes: list[int] = []
    opened = 0

    def release(size: int, first: int, count: int) -> None:
        if size and count:
            if size not in gaps:
                insort(sizes, size)
                gaps[size] = []
            gaps[size].append((first, count))

    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        placed, total = 0, counts[length]
        while placed < total:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                break
            size = sizes[at]
            open_runs = gaps.pop(size)
            sizes.pop(at)
            for first, count in open_runs:
                taken = min(count, total - placed)
                if taken:
                    runs.append(Run(length, placed, placed + taken, first, capacity - size))
                    placed += taken
                    release(size - length, first, taken)
                release(size, first + taken, count - taken)
        each = capacity // length
        full, rest = divmod(total - placed, each)
        for slot in range(each):
            if full:
                runs.append(Run(length, placed, placed + full, opened, slot * length))
                placed += full
        release(capacity - each * length, opened, full)
        opened += full
        for slot in range(rest):
            runs.append(Run(length, placed, placed + 1, opened, slot * length))
            placed += 1
        if rest:
            release(capacity - rest * length, opened, 1)
            opened += 1
    return runs


def pack(
    docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str | None = None,
    capacity: int = CAPACITY, end: int = END, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: key, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``, and the ids if asked for.

    A null text is an empty document of one token. Null and repeated keys are packed like others;
    other columns are not looked at. An empty table gives no rows.
    """
    pieces = cut_pieces(docs, text, key, tokenizer, capacity, end, with_ids)
    counts = written(pieces.groupBy("__task", "length").agg(F.count("*").alias("n")), "lengths")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one per length
    runs = match_rounds(totals, capacity)
    spark = docs.sparkSession
    plan = spark.createDataFrame([(r.length, r.first, r.last, r.sequence, r.offset) for r in runs],
                                 "length long, __first long, __last long, __sequence long, offset long")
    if len(runs) <= BROADCAST_RUNS:
        plan = F.broadcast(plan)
    before = Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("__base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = pieces.join(bases, ["__task", "length"]).withColumn("__at", F.col("__base") + F.col("__rank"))
    placed = ranked.join(plan, "length").where((F.col("__at") >= F.col("__first")) & (F.col("__at") < F.col("__last")))
    return placed.select(
        F.col("key").alias(key), "piece", "start", "length", "ids_crc32",
        (F.col("__sequence") + F.col("__at") - F.col("__first")).alias("sequence_id"), "offset", *["ids"] * with_ids)
