"""A content hash of files of any size, computed by many tasks.

A file is a sequence of blocks of one mebibyte, whatever splits it is read in. Tasks hash the blocks that lie inside
their split; the parts of a block that a border cuts meet by the block's number. The hash of a file is that of its groups'
hashes in order, and a group's is that of its blocks'. So it depends on the content alone, and changes with any byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
GROUP_BLOCKS = 4_096


def _blocks(starts: dict[tuple[str, int], tuple[int, int]], size: int):
    """The blocks of a task: a hash for each one that is whole, the bytes of the parts of others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, end, held = None, 0, 0, bytearray()
        out: list[tuple] = []

        def cut(last: bool) -> None:
            """Whole blocks leave the buffer, and at the end of a split the rest does."""
            nonlocal at
            while held and (last or len(held) >= size):
                room = size - at % size
                if len(held) < room and not last:
                    return
                part = bytes(held[:room])
                del held[:room]
                whole = len(part) == size
                out.append((key[0], at // size, at, hashlib.sha256(part).digest() if whole else None, None if whole else part))
                at += len(part)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 5
            out.clear()
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "block", "start", "digest", "part"])

        def finish() -> None:
            del held[max(0, end - at):]  # the last line of a file may have no line break
            cut(True)

        for batch in batches:
            for file, split, value in zip(*(batch.column(c).to_pylist() for c in ("__file", "__split", "value"))):
                if (file, split) != key:
                    if key is not None:
                        finish()
                    key = (file, split)
                    if key not in starts:
                        raise RuntimeError(f"{file} was split differently when it was read again; read it once more")
                    (at, end), held = starts[key], bytearray()
                held += value + b"\n"
                if len(held) >= size:
                    cut(False)
            yield flush()
        if key is not None:
            finish()
            yield flush()
    return run


def content_digests(spark: SparkSession, paths, block_bytes: int = BLOCK_BYTES, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """``(path, tree_sha256)`` of each file. A file without bytes has no row."""
    rows = spark.read.text(paths, lineSep="\n").select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__split"), F.col("_metadata.file_size").alias("__size"))
    splits = rows.groupBy("__file", "__split").agg(F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("__size").alias("size")).collect()
    # One entry per split, like the list of splits that the driver holds for the scan.
    starts, last, at = {}, None, 0
    for r in sorted(splits, key=lambda r: (r["__file"], r["__split"])):
        at = at if r["__file"] == last else 0
        starts[(r["__file"], r["__split"])] = (at, min(at + r["bytes"], r["size"]))
        last, at = r["__file"], at + r["bytes"]
    blocks = rows.select("value", "__file", "__split").mapInArrow(
        _blocks(starts, block_bytes), "path string, block bigint, start bigint, digest binary, part binary")
    whole = F.sha2(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "part"))), lambda p: F.hex(p["part"])), "")), 256)
    cut = blocks.where("part IS NOT NULL").groupBy("path", "block").agg(whole.alias("digest"))
    single = blocks.where("digest IS NOT NULL").select("path", "block", F.lower(F.hex("digest")).alias("digest"))
    every = single.unionAll(cut).withColumn("group", F.floor(F.col("block") / group_blocks))

    def joined(number: str):
        ordered = F.sort_array(F.collect_list(F.struct(number, "digest")))
        return F.sha2(F.array_join(F.transform(ordered, lambda d: d["digest"]), ""), 256)
    groups = every.groupBy("path", "group").agg(joined("block").alias("digest"))
    return groups.groupBy("path").agg(joined("group").alias("tree_sha256"))
