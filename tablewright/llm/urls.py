"""URL filters: host and path rules, and a cascade of Bloom filters that answers membership exactly without a join."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import blobs
from tablewright.llm.flat import mix
from tablewright.llm.text import LETTERS, LOWERED, whole
from tablewright.session import written

KEYS_PER_SHARD = 200_000
LEAST_SHARDS = 16
BROADCAST_BYTES = 64_000_000
ROWS_PER_TASK = 1_000_000  # keys of one shard, where filters are too large to broadcast
BITS_PER_KEY, PROBES = 10, 7
MOST_LEVELS = 64
VERDICTS = ("block", "allow")
_U = np.uint64


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Fixed values of the contract.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """What stands from the first :// to a slash, question mark, hash or the end, A-Z lowered; empty without one."""
    return F.translate(F.regexp_extract(whole(url), r"(?s)^.*?://([^/?#]*)", 1), LETTERS, LOWERED)


def path_of(url: Column) -> Column:
    return F.regexp_extract(whole(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def shapes_of(rules: DataFrame) -> list[tuple[int, int]]:
    """How many labels the rules' hosts have and how many characters their paths: each pair that occurs, once.

    As many as there are distinct pairs, however long the list of rules is.
    """
    labels = F.size(F.split("host", r"\.")).alias("labels")
    return sorted((r["labels"], r["length"]) for r in rules.select(labels, F.length("path").alias("length")).distinct().collect())


def candidates(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> Column:
    """The names of all rules of these shapes that would fit: ``size``, ``wide``, ``host``, ``path``; longest first.

    A host or path that is shorter than a shape stands for itself, which fits as well. Of equal lengths the longer host comes first.
    """
    def one(shape: Column) -> Column:
        above = F.call_function("substring_index", host, F.lit("."), -shape["labels"])
        begin = F.substring(path, F.lit(1), shape["length"])
        return F.struct((F.length(above) + F.length(begin)).alias("size"), F.length(above).alias("wide"), above.alias("host"), begin.alias("path"))

    if not shapes:
        return F.array().cast("array<struct<size:int,wide:int,host:string,path:string>>")
    each = F.array(*[F.struct(F.lit(n).alias("labels"), F.lit(length).alias("length")) for n, length in shapes])
    return F.sort_array(F.array_distinct(F.transform(each, one)), asc=False)


def _bits(h: np.ndarray, g: np.ndarray, level: int, size: int) -> np.ndarray:
    """The places of each key in a level's filter: keys x probes."""
    salted = mix(h + _U(level * 0x9E3779B97F4A7C15 % (1 << 64)))
    step = mix(g ^ salted) | _U(1)
    return (salted[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * step[:, None]) % _U(size)


def _insert(h: np.ndarray, g: np.ndarray, level: int) -> np.ndarray:
    size = 8 * max(8, math.ceil(len(h) * BITS_PER_KEY / 8))
    flags = np.zeros(size, np.uint8)
    flags[_bits(h, g, level, size).reshape(-1).astype(np.int64)] = 1
    return np.packbits(flags)


def _holds(bits: np.ndarray, h: np.ndarray, g: np.ndarray, level: int) -> np.ndarray:
    places = _bits(h, g, level, 8 * len(bits))
    return ((bits[(places >> _U(3)).astype(np.int64)] >> (_U(7) - (places & _U(7))).astype(np.uint8)) & 1).all(axis=1)


def build_levels(h: np.ndarray, g: np.ndarray, listed: np.ndarray) -> list[np.ndarray]:
    """Filters for one shard: listed keys, then the others that pass, then the listed that pass those, until none does."""
    levels, own, other = [], np.flatnonzero(listed), np.flatnonzero(~listed)
    while len(own):
        if len(levels) == MOST_LEVELS:
            raise ValueError("listed and unlisted keys with equal hashes can't be told apart")
        bits = _insert(h[own], g[own], len(levels))
        passing = other[_holds(bits, h[other], g[other], len(levels))]
        levels.append(bits)
        own, other = passing, own
    return levels


def is_listed(levels: Sequence[np.ndarray], h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The first filter that a key fails decides: at an odd place it isn't listed, at an even one it is."""
    answer, left = np.zeros(len(h), bool), np.arange(len(h))
    for level, bits in enumerate(levels):
        passing = _holds(bits, h[left], g[left], level)
        answer[left[~passing]] = level % 2 == 1
        left = left[passing]
    answer[left] = len(levels) % 2 == 1
    return answer


def key_hashes(verdict: Column, host: Column, path: Column) -> tuple[Column, Column]:
    return F.xxhash64(verdict, host, path), F.xxhash64(path, F.lit("|"), host, verdict)


def build_cascade(keys: DataFrame, shards: int) -> DataFrame:
    """One row per shard with a listed key: its filters in one blob. ``keys`` has every key of the corpus once: h, g, listed."""
    def run(table: pa.Table) -> pa.Table:
        h, g = (table.column(c).to_numpy().view(np.uint64) for c in ("h", "g"))
        levels = build_levels(h, g, table.column("listed").to_numpy(zero_copy_only=False))
        rows = [(table.column("shard")[0].as_py(), len(levels), blobs.join(levels))] if levels else []
        shard, count, data = list(zip(*rows)) or [()] * 3
        return pa.table({"shard": pa.array(shard, pa.int32()), "levels": pa.array(count, pa.int32()), "bits": pa.array(data, pa.binary())})

    placed = keys.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    return placed.groupBy("shard").applyInArrow(run, "shard int, levels int, bits binary")


def _levels(row) -> list[np.ndarray]:
    return blobs.split(row["bits"], ["u1"] * row["levels"])


def _answers(h: np.ndarray, g: np.ndarray, shards: int, filters: dict[int, list[np.ndarray]]) -> np.ndarray:
    """Whether each key is listed."""
    shard = (h.view(np.int64) % shards).astype(np.int64)
    out = np.zeros(len(h), bool)
    for s in np.unique(shard).tolist():
        if s in filters:
            mine = np.flatnonzero(shard == s)
            out[mine] = is_listed(filters[s], h[mine], g[mine])
    return out


def probe(rows: DataFrame, cascade: DataFrame, shards: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` (with __h and __g, arrays of key hashes) and the place of the first listed key of each, as ``__place``; else null.

    The filters go to every task while they are small; else the keys of each shard meet its filters,
    a shard of many keys dealt over several tasks with a copy of the filters each, and only the places of listed
    keys come back to the rows.
    """
    size = cascade.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", __place int"
        held = rows.sparkSession.sparkContext.broadcast({r["shard"]: (r["levels"], r["bits"]) for r in cascade.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {s: blobs.split(bits, ["u1"] * n) for s, (n, bits) in held.value.items()}
            for batch in batches:
                h, g = batch.column("__h"), batch.column("__g")
                sizes = np.diff(h.offsets.to_numpy())
                begin = np.concatenate([[0], np.cumsum(sizes)])
                listed = _answers(*(c.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in (h, g)), shards, filters)
                hits = np.flatnonzero(listed)
                row = np.searchsorted(begin, hits, side="right") - 1
                row, first = np.unique(row, return_index=True)  # hits are in order, so the first is the smallest
                place, missing = np.zeros(len(sizes), np.int32), np.ones(len(sizes), bool)
                place[row], missing[row] = hits[first] - begin[row], False
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, mask=missing)], [*batch.schema.names, "__place"])
        return rows.mapInArrow(run, schema)

    rows = written(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
    each = rows.select("__row", F.posexplode(F.arrays_zip("__h", "__g")).alias("__place", "k")).select("__row", "__place", "k.*")
    shard = F.pmod("__h", F.lit(shards)).cast("int")
    most = each.groupBy(shard.alias("s")).count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    parts = math.ceil(most / ROWS_PER_TASK)
    dealt = each.withColumns({"__shard": shard, "__part": F.pmod(F.xxhash64("__row"), F.lit(parts)).cast("int")})
    copies = cascade.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        filters = {r["shard"]: _levels(r) for r in right.to_pylist()}
        h, g = (left.column(n).to_numpy().view(np.uint64) for n in ("__h", "__g"))
        return left.select(["__row", "__place"]).filter(pa.array(_answers(h, g, shards, filters)))
    hits = dealt.groupBy("__shard", "__part").cogroup(copies.groupBy("shard", "__part")).applyInArrow(meet, "__row long, __place int")
    first = hits.groupBy("__row").agg(F.min("__place").alias("__place"))
    return rows.join(first, "__row", "left").drop("__row")


def rule_table(spark: SparkSession, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """Rules as a table of ``verdict`` (block or allow), ``host`` and ``path``."""
    if isinstance(rules, DataFrame):
        return rules.select("verdict", "host", "path")
    return spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")


def judge(pages: DataFrame, url: str = "url", rules: Sequence[Rule] | DataFrame = RULES, broadcast_bytes: int = BROADCAST_BYTES,
          keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    A page asks for every rule that would fit it: its host or a domain above it, the beginning of its path, and a verdict. These
    questions of all pages are the universe of keys, the rules are the listed ones, and the cascade over both answers each question
    exactly. The longest rule found decides (of one name with both verdicts, block). Rules are a list or a table; their number costs nothing in
    the plan. A page without a rule is allowed: also a null url, or one without ://, with empty host and path.
    Repeated rows are judged alike, an empty table gives no rows, without rules all pages are allowed, and columns
    of ``pages`` with one of the four names are replaced.
    """
    added = ("host", "path", "rule", "verdict")
    given = [F.col(f"`{c}`") for c in pages.columns if c not in added]
    split = pages.select(*given, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    listed = rule_table(pages.sparkSession, rules)
    shapes = shapes_of(listed)
    fits = candidates(F.col("host"), F.col("path"), shapes)

    def hashes(which: int) -> Column:
        return F.flatten(F.transform(fits, lambda c: F.array(*[key_hashes(F.lit(v), c["host"], c["path"])[which] for v in VERDICTS])))
    asked = split.select(*given, "host", "path", hashes(0).alias("__h"), hashes(1).alias("__g"))
    h, g = key_hashes(F.col("verdict"), F.col("host"), F.col("path"))
    universe = asked.select(F.explode(F.arrays_zip("__h", "__g")).alias("k")).select(F.col("k.__h").alias("h"), F.col("k.__g").alias("g"), F.lit(False).alias("listed"))
    universe = universe.union(listed.select(h, g, F.lit(True)))
    keys = written(universe.groupBy("h", "g").agg(F.max("listed").alias("listed")), "keys")
    shards = max(LEAST_SHARDS, math.ceil(keys.count() / keys_per_shard))
    cascade = written(build_cascade(keys, shards), "cascade")
    judged = probe(asked, cascade, shards, broadcast_bytes).drop("__h", "__g")
    found = F.get(fits, F.floor(F.col("__place") / len(VERDICTS)).cast("int"))
    verdict = F.coalesce(F.get(F.array(*map(F.lit, VERDICTS)), F.pmod("__place", F.lit(len(VERDICTS)))), F.lit("allow"))
    return judged.withColumns({"rule": F.concat(found["host"], found["path"]), "verdict": verdict}).drop("__place")
