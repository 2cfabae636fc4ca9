"""How each delimited file is written: its delimiter, encoding, header and whether quotes hold line breaks."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import rows_per_batch
from tablewright.sources.normalize import IngestError

# Fixed values.
DELIMITERS = (",", ";", "\t", "|")
SNIFF_CHARS = 64 * 1024  # of the text that the delimiter is sniffed from
# The bytes 0x80 to 0x9f of the Windows code page 1252, in order; the five it leaves undefined are 81 8d 8f 90 9d.
CP1252_BYTES = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_UNDEFINED = "[\u0081\u008d\u008f\u0090\u009d]"

HEAD_LINES = 1_000  # lines of a file that its delimiter may be sniffed from
MOST_DIALECTS = 200


@dataclass(frozen=True)
class Dialect:
    """Files that are read alike."""
    delimiter: str
    encoding: str
    header: tuple[str, ...]
    broken: bool  # a quoted field may hold a line break, so that lines are no records
    files: tuple[str, ...]


def sniff_delimiter(lines: Sequence[str]) -> str:
    """The candidate that splits every line into the same number of fields, the most fields first; else a comma."""
    bare = [re.sub(r'"[^"]*"', "", line.replace('""', "")) for line in lines if line.strip()]
    best, most = ",", 0
    for d in DELIMITERS:
        counts = [line.count(d) for line in bare]
        if counts and len(set(counts)) == 1 and counts[0] > most:
            best, most = d, counts[0]
    if most:
        return best
    # No candidate is even: take the one on most lines that agree with the header.
    for d in DELIMITERS:
        agree = sum(line.count(d) == bare[0].count(d) for line in bare) if bare and bare[0].count(d) else 0
        if agree > most and agree >= 0.9 * len(bare):
            best, most = d, agree
    return best


def _records(lines: Sequence[str]) -> list[str]:
    """Lines joined where a quote is still open."""
    out, open_ = [], False
    for line in lines:
        if open_:
            out[-1] += "\n" + line
        else:
            out.append(line)
        open_ ^= line.count('"') % 2 == 1
    return out


def _look(delimiter: str | None):
    """Delimiter and header of each file from its first lines; of the other lines nothing is kept.

    Whole lines as far as the sniffed text goes, and on while a quote that the first record opened is not closed. The
    lines of a file follow each other.
    """
    def found(file: str, lines: list[str]) -> pa.RecordBatch:
        records = [r for r in _records(lines) if r.strip()]
        room, sniffed = SNIFF_CHARS, []
        for record in records:
            if room <= 0:
                break
            sniffed.append(record[:room].replace("\n", " "))
            room -= len(record)
        mark = delimiter or sniff_delimiter(sniffed)
        # The first record is read whole, however wide the table is.
        names = next(csv.reader(io.StringIO(records[0]), delimiter=mark), []) if records else []
        return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([mark]), pa.array([names], pa.list_(pa.string()))], ["file", "delimiter", "header"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, lines, chars, quotes, closed = None, [], 0, 0, False
        for batch in batches:
            for name, values in _by_file(batch):
                if name != file:
                    if file is not None:
                        yield found(file, lines)
                    file, lines, chars, quotes, closed = name, [], 0, 0, False
                for value in values:
                    if closed and (len(lines) >= HEAD_LINES or chars >= SNIFF_CHARS):
                        break
                    lines.append(value.as_py().decode("latin-1"))
                    chars += len(lines[-1])
                    quotes += lines[-1].count('"')
                    closed = closed or (quotes % 2 == 0 and chars > 0)
        if file is not None:
            yield found(file, lines)
    return run


def _by_file(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """The lines of a batch, file by file."""
    if not batch.num_rows:
        return
    files = batch.column("file").dictionary_encode()
    codes = files.indices.to_numpy()
    edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
    for a, b in zip(edges[:-1], edges[1:]):
        yield files.dictionary[int(codes[a])].as_py(), batch.column("value").slice(a, b - a)


def _lines(spark: SparkSession, paths) -> DataFrame:
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.withColumn("raw", F.decode(F.col("value").cast("binary"), "ISO-8859-1"))


def dialects(spark: SparkSession, paths, delimiter: str | None = None) -> list[Dialect]:
    """The ways in which the files at a path are written, each with its files.

    All lines are tested for their encoding and for open quotes in one aggregate by file; delimiter and
    header come from the first lines of each file, which stay where they are read. What reaches the
    driver is one row per file, like the listing of the files itself.
    """
    lines = _lines(spark, paths)
    tested = lines.groupBy("file").agg(
        F.count_if(~F.is_valid_utf8("value")).alias("bad"),
        F.count_if(F.col("raw").rlike(CP1252_UNDEFINED)).alias("undefined"),
        F.count_if((F.length("raw") - F.length(F.replace("raw", F.lit('"'), F.lit("")))) % 2 == 1).alias("open"))
    heads = lines.where("block = 0").select("file", F.col("value").cast("binary").alias("value"))
    looked = heads.mapInArrow(_look(delimiter), "file string, delimiter string, header array<string>")
    groups: dict[tuple, list[str]] = {}
    with rows_per_batch(spark, HEAD_LINES):
        found = tested.join(looked, "file").collect()
    for r in found:
        encoding = "utf-8" if not r["bad"] else "latin-1" if r["undefined"] else "cp1252"
        names = tuple(_decoded(n, encoding) for n in r["header"])
        if names:
            names = (names[0].lstrip("﻿"), *names[1:])
            groups.setdefault((r["delimiter"], encoding, names, bool(r["open"])), []).append(r["file"])
    if len(groups) > MOST_DIALECTS:
        raise IngestError(f"The files are written in more than {MOST_DIALECTS} different ways.")
    return [Dialect(d, e, h, o, tuple(sorted(files))) for (d, e, h, o), files in sorted(groups.items())]


def _decoded(raw: str, encoding: str) -> str:
    if encoding == "utf-8":
        return raw.encode("latin-1").decode("utf-8")
    return raw.translate(str.maketrans(CP1252_BYTES, CP1252_CHARS)) if encoding == "cp1252" else raw
