"""Lines that several documents hold, kept in the first of them only.

1. Each task sends one entry per distinct line key: a 128-bit hash, how many of its rows hold the line,
   and the smallest of their documents. Entries of one hash are added up.
2. The hashes are dealt over shards by their leading bits. An owner task builds a minimal perfect hash over
   all hashes of its shard: a slot for every line and none to spare. Arrays in slot order hold a
   fingerprint and the number of documents; the smallest document stands in a third array for the
   lines that repeat, found by rank.
3. Documents probe the arrays: their hashes go to the shard, never the lines, and what comes back is
   the list of lines that a document loses. A shard that many probes ask for is copied to several tasks.
4. Documents meet their lists and are cut.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import blobs
from tablewright.llm.flat import mix
from tablewright.session import written

# Fixed values of the contract.
STRIPPED = b" \t\n\x0b\x0c\r"
LEAST_CHARS = 10
LEAST_DOCUMENTS = 2

SHARD_KEYS = 500_000  # distinct lines of a shard, on average
PROBES_PER_TASK = 1_000_000
ENTRIES_PER_FLUSH = 1_000_000
NULL_KEY = np.int64(2 ** 63 - 1)  # a null key is larger than all others
GAMMA = 1.5  # bits per key of a level
_U = np.uint64


# -- the minimal perfect hash --------------------------------------------------------------


def _slots(h: np.ndarray, g: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(h + g * _U(2 * level + 1) + _U(level)) % _U(bits)).astype(np.int64)


def build_levels(h: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
    """Bit arrays, one per level: a key owns the bit of the first level where no other key falls on it.

    ``h`` and ``g`` are the halves of distinct 128-bit hashes. Keys that share a bit go on to the next level.
    """
    levels = []
    while len(h):
        bits = max(8, math.ceil(GAMMA * len(h) / 8) * 8)
        at = _slots(h, g, len(levels), bits)
        alone = np.bincount(at, minlength=bits) == 1
        levels.append(np.packbits(alone, bitorder="little"))
        left = ~alone[at]
        h, g = h[left], g[left]
    return levels


class PerfectHash:
    """Numbers the keys that it was built over from 0 without gaps; any other key gets some number or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.words = [np.pad(bits, (0, -len(bits) % 8)).view("<u8") for bits in levels]
        sizes = [int(np.bitwise_count(w).sum()) for w in self.words]
        self.before = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        # Set bits before each word of a level.
        self.ranks = [np.concatenate([[0], np.cumsum(np.bitwise_count(w), dtype=np.int64)]) for w in self.words]

    def __len__(self) -> int:
        return int(self.before[-1])

    def __call__(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for level, words in enumerate(self.words):
            at = _slots(h[left], g[left], level, len(self.levels[level]) * 8)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & _U(1)) > 0
            below = np.bitwise_count(word & ((_U(1) << bit) - _U(1))).astype(np.int64)
            out[left[hit]] = (self.before[level] + self.ranks[level][at >> 6] + below)[hit]
            left = left[~hit]
        return out


class LineIndex:
    """A shard: the perfect hash, and arrays of fingerprints, counts and first documents in its order."""

    KINDS = ["<u4", "<u4", "<i8"]

    def __init__(self, levels: list[np.ndarray], marks: np.ndarray, counts: np.ndarray, firsts: np.ndarray):
        self.slot = PerfectHash(levels)
        self.marks, self.counts, self.firsts = marks, counts, firsts
        self.rank = np.cumsum(counts >= LEAST_DOCUMENTS) - 1  # a line's place among those that repeat

    @staticmethod
    def build(h: np.ndarray, g: np.ndarray, count: np.ndarray, first: np.ndarray) -> tuple[int, bytes]:
        """Number of levels, and the blob."""
        levels = build_levels(h, g)
        at = PerfectHash(levels)(h, g)
        marks, counts = np.zeros(len(h), np.uint32), np.zeros(len(h), np.uint32)
        firsts = np.zeros(len(h), np.int64)
        marks[at] = (g >> _U(32)).astype(np.uint32)
        counts[at] = np.minimum(count, 2 ** 32 - 1)
        firsts[at] = first
        return len(levels), blobs.join([*levels, marks, counts, firsts[counts >= LEAST_DOCUMENTS]])

    @staticmethod
    def read(levels: int, data: bytes) -> LineIndex:
        parts = blobs.split(data, ["u1"] * levels + LineIndex.KINDS)
        return LineIndex(parts[:levels], *parts[levels:])

    def lookup(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many documents hold each line (0 for a line that the fingerprint does not know), and the first of those that repeat."""
        at = self.slot(h, g)
        known = at >= 0
        known[known] = self.marks[at[known]] == (g[known] >> _U(32)).astype(np.uint32)
        counts, first = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        counts[known] = self.counts[at[known]]
        several = counts >= LEAST_DOCUMENTS
        first[several] = self.firsts[self.rank[at[several]]]
        return counts, first


# -- lines of a text -----------------------------------------------------------------------


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lowered."""
    return line.strip(STRIPPED).lower()


def _counts(key: bytes) -> bool:
    """Whether the key has enough code points to be looked at."""
    n = len(key)
    return n >= 4 * LEAST_CHARS or (n >= LEAST_CHARS and len(key.decode()) >= LEAST_CHARS)


def key_hashes(text: bytes) -> set[bytes]:
    """The distinct hashes of a text's lines that are long enough."""
    keys = {k for k in map(line_key, text.split(b"\n")) if _counts(k)}
    return set(map(xxhash.xxh3_128_digest, keys))


def _halves(digests: bytes) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(digests, "<u8").reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for value in batch.column("text").cast(pa.large_binary()):
        yield value.as_py() or b""


def _order(keys: pa.Array) -> np.ndarray:
    return keys.fill_null(int(NULL_KEY)).to_numpy(zero_copy_only=False)


def _lines(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, h and g of every distinct line of every text."""
    found = [key_hashes(t) for t in _texts(batch)]
    rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
    return rows, *_halves(b"".join(d for f in found for d in f))


def _combined(h: np.ndarray, g: np.ndarray, count: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    if not len(h):
        return [h, g, count, first]
    order = np.lexsort((g, h))
    h, g, count, first = h[order], g[order], count[order], first[order]
    begins = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))
    return [h[begins], g[begins], np.add.reduceat(count, begins), np.minimum.reduceat(first, begins)]


# -- steps ---------------------------------------------------------------------------------


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct lines of a task with their rows and smallest document, flushed as they come to many."""
    held: list[list[np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        h, g, count, first = _combined(*[np.concatenate(c) for c in zip(*held)])
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(count), pa.array(first)],
                                          ["h", "g", "n", "first"])

    for batch in batches:
        rows, h, g = _lines(batch)
        held.append([h, g, np.ones(len(h), np.int64), _order(batch.column("key"))[rows]])
        if sum(len(c[0]) for c in held) > ENTRIES_PER_FLUSH:
            yield flush()
    if held:
        yield flush()


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(shards) >> _U(32)).astype(np.int32)


def _shard_column(shards: int):
    return F.expr(f"cast(shiftrightunsigned(shiftrightunsigned(h, 32) * {shards}, 32) as int)")


def build_index(docs: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """The index over all lines of ``docs`` (key, text), one row per shard, and the number of shards.

    ``probes`` is how many rows hold a line of the shard: what the documents will ask it.
    """
    entries = written(docs.mapInArrow(_entries, "h long, g long, n long, first long"), "line-entries")
    shards = max(1, math.ceil(entries.count() / shard_keys))
    lines = entries.groupBy("h", "g").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    lines = lines.withColumn("shard", _shard_column(shards))

    def build(table: pa.Table) -> pa.Table:
        h, g = (table.column(c).to_numpy().view(np.uint64) for c in ("h", "g"))
        n = table.column("n").to_numpy()
        levels, data = LineIndex.build(h, g, n, table.column("first").to_numpy())
        return pa.table({"shard": table.column("shard")[:1], "levels": pa.array([levels], pa.int32()),
                         "probes": pa.array([int(n.sum())], pa.int64()), "data": pa.array([data], pa.binary())})

    built = lines.groupBy("shard").applyInArrow(build, "shard int, levels int, probes long, data binary")
    return written(built, "line-index"), shards


def _probes(shards: int, parts: int):
    """The hashes of a task's documents, by shard and part: who asks, and the two halves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, h, g = _lines(batch)
            key, salt = _order(batch.column("key"))[rows], batch.column("salt").to_numpy()[rows]
            bucket = _shard_of(h, shards).astype(np.int64) * parts + (salt.view(np.uint64) % _U(parts)).astype(np.int64)
            out = [(b, blobs.join(c)) for b, c in blobs.by_bucket(bucket, [key, salt, h, g], shards * parts)]
            shard, data = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b // parts for b in shard], pa.int32()), pa.array([b % parts for b in shard], pa.int32()), pa.array(data, pa.binary())],
                ["shard", "part", "data"])
    return run


def _answer(left: pa.Table, right: pa.Table) -> pa.Table:
    """The lines that documents lose: who, and the first half of the hash."""
    out = [np.zeros(0, np.int64)] * 3
    index = [LineIndex.read(r["levels"], r["data"]) for r in right.to_pylist()]
    if index and len(left):
        key, salt, h, g = blobs.gather(left.column("data").to_pylist(), ["<i8", "<i8", "<u8", "<u8"])
        counts, first = index[0].lookup(h, g)
        lost = (counts >= LEAST_DOCUMENTS) & (first != key)
        out = [key[lost], salt[lost], h[lost].view(np.int64), g[lost].view(np.int64)]
        order = np.lexsort((out[1], out[0]))
        out = [c[order] for c in out]
        begins = np.flatnonzero(np.concatenate([[True], (out[0][1:] != out[0][:-1]) | (out[1][1:] != out[1][:-1])])) if len(order) else order
        both = np.stack([out[2], out[3]], 1)
        edges = [*begins.tolist(), len(order)]
        gone = [both[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
        key, salt = out[0][begins], out[1][begins]
    else:
        key, salt, gone = out[0], out[1], []
    return pa.table({"key": pa.array(key, pa.int64()), "salt": pa.array(salt, pa.int64()), "gone": pa.array(gone, pa.binary())})


def _without(text: bytes, lists: list[bytes] | None) -> tuple[int, int, bytes]:
    """Lines of a text, lines that it loses, and what is left."""
    if not lists:
        return text.count(b"\n") + 1, 0, text
    data = b"".join(lists)
    lost = {data[i:i + 16] for i in range(0, len(data), 16)}
    lines = text.split(b"\n")
    stays = [ln for ln in lines if not (_counts(k := line_key(ln)) and xxhash.xxh3_128_digest(k) in lost)]
    return len(lines), len(lines) - len(stays), b"\n".join(stays)


def _cut(with_text: bool):
    names = ["key", "n_lines", "n_dropped", "kept_sha256", *["kept_text"] * with_text]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, lists in zip(batch.column("key").to_pylist(), _texts(batch), batch.column("gone")):
                total, dropped, kept = _without(text, lists.as_py())
                rows.append((key, total, dropped, hashlib.sha256(kept).hexdigest(), *[kept.decode()] * with_text))
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)
    return run


def drop_repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", shard_keys: int = SHARD_KEYS,
                        probes_per_task: int = PROBES_PER_TASK, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: its key, ``n_lines``, ``n_dropped``, ``kept_sha256``, and ``kept_text`` if asked for.

    Lines are compared without white space at their ends and with A-Z lowered, if 10 code points are
    left. A line that two rows hold goes from all rows but those of the smallest key. A null
    text is one empty line. A null key is larger than all others; rows that share a key, or have none, count as
    several rows but lose nothing to each other. A line that repeats inside one row only stays, and goes or
    stays as a whole otherwise. An empty table gives no rows; other columns are not looked at. Keys are integers.
    """
    # Only the load is dealt by the salt: what a document loses depends on its key and its lines.
    docs = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    salted = docs.withColumn("salt", F.xxhash64("text"))
    index, shards = build_index(docs, shard_keys)
    most = index.agg(F.coalesce(F.max("probes"), F.lit(0))).first()[0]
    parts = max(1, math.ceil(most / probes_per_task))
    copies = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = salted.mapInArrow(_probes(shards, parts), "shard int, part int, data binary")
    answers = asked.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(_answer, "key long, salt long, gone binary")
    lost = written(answers.where(F.length("gone") > 0), "lost-lines")
    lists = lost.groupBy(F.col("key").alias("k"), F.col("salt").alias("s")).agg(F.collect_list("gone").alias("gone")).hint("shuffle_hash")
    ordered = F.coalesce("key", F.lit(int(NULL_KEY)))
    met = salted.join(lists, (ordered == F.col("k")) & (F.col("salt") == F.col("s")), "left").select("key", "text", "gone")
    cut = met.mapInArrow(_cut(with_text), "key long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text)
    return cut.withColumnRenamed("key", key)
