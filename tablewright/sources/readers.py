"""Reading files into tables: delimited text, JSON, JSON Lines and Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import values as V
from tablewright.functions.kinds import q
from tablewright.session import shared_folder
from tablewright.sources.borders import JsonList, QuotedText, records
from tablewright.sources.dialects import CP1252_BYTES, CP1252_CHARS, Dialect, dialects
from tablewright.sources.digests import content_digests
from tablewright.sources.normalize import REPORT, IngestError, Ingested, blank_tokens, flatten, normalize
from tablewright.sources.writers import write_table

# Fixed values.
FORMATS = {"csv": "delimited", "tsv": "delimited", "txt": "delimited", "parquet": "parquet", "json": "json",
           "jsonl": "jsonl"}
TRUE_FALSE = ("True", "TRUE", "true", "False", "FALSE", "false")

HASHED_BYTES = 1 << 30  # larger files are hashed by blocks
MOST_FIELDS = 20_480  # of a record, or twice those of the header
_WHOLE_LINE = "__line"


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """``(path, bytes, sha256, tree_sha256)`` of each file, hashed where it is read.

    Up to ``HASHED_BYTES`` a file is one value to the hash, ``sha256``. A larger one has the hash over its blocks, ``tree_sha256``.
    """
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= HASHED_BYTES).select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.lit(None).cast("string").alias("tree_sha256"))
    large = {r["path"]: r["length"] for r in files.where(F.col("length") > HASHED_BYTES).select("path", "length").collect()}
    if not large:
        return small
    sizes = spark.createDataFrame(list(large.items()), "path string, bytes bigint")
    same_place = F.regexp_replace("path", "^file:/+", "file:/")  # both readers name a local file, with one slash or three
    trees = content_digests(spark, list(large)).select(same_place.alias("p"), "tree_sha256")
    found = sizes.join(trees, same_place == F.col("p"), "left")
    return small.unionAll(found.select("path", "bytes", F.lit(None).cast("string").alias("sha256"), "tree_sha256"))


def _decoded(c: Column, encoding: str) -> Column:
    """Text read as Latin-1 becomes code page 1252 by renaming 27 characters."""
    return F.translate(c, CP1252_BYTES, CP1252_CHARS) if encoding == "cp1252" else c


def infer_types(df: DataFrame, *tests: Column) -> tuple[DataFrame, Row]:
    """Text columns that hold only whole numbers, numbers or flags get that type; text is never read as dates.

    ``tests`` are further aggregates for the same pass over the table.
    """
    whole = r"^\s*[+-]?\d{1,18}\s*$"
    infinite = r"^\s*[+-]?(inf|infinity)\s*$"
    names = [c for c in df.columns if c != _WHOLE_LINE]
    counts = list(tests)
    for i, c in enumerate(names):
        v = q(c)
        counts += [
            F.count(v).alias(f"n{i}"), F.count_if(v.rlike(whole)).alias(f"w{i}"),
            F.count_if(v.rlike(V.NUMBER_PATTERN) | F.lower(v).rlike(infinite)).alias(f"d{i}"),
            F.count_if(v.isin(*TRUE_FALSE)).alias(f"b{i}"),
            F.count_if(v.rlike(r"^\s*[+-]?\d{19,}\s*$")).alias(f"l{i}"),
        ]
    seen = df.agg(*counts).first()
    columns = []
    for i, c in enumerate(names):
        n = seen[f"n{i}"]
        if n and seen[f"w{i}"] == n:
            columns.append(F.trim(q(c)).cast("bigint").alias(c))
        elif n and seen[f"d{i}"] == n and not seen[f"l{i}"]:
            columns.append(F.trim(q(c)).cast("double").alias(c))
        elif n and seen[f"b{i}"] == n:
            columns.append((F.lower(q(c)) == "true").alias(c))
        else:
            columns.append(q(c))
    return df.select(*columns), seen


def _text_columns(spark: SparkSession, found: Sequence[Dialect]) -> DataFrame:
    """The files of all dialects as text columns c0, c1, ... in the order of the first header, and the line where it has surplus fields."""
    first, *others = found
    parts = []
    for d in found:
        names = [f"c{i}" for i in range(len(d.header))]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, _WHOLE_LINE)])
        charset = "UTF-8" if d.encoding == "utf-8" else "ISO-8859-1"
        options = {"sep": d.delimiter, "quote": '"', "escape": '"', "columnNameOfCorruptRecord": _WHOLE_LINE,
                   "maxColumns": str(max(MOST_FIELDS, 2 * len(names)))}
        if d.broken:
            found_records, ends, _ = records(spark, list(d.files), QuotedText(d.delimiter))
            unclosed = [PurePosixPath(f).name for f, open_ in ends.items() if open_]
            if unclosed:
                raise IngestError(f"A quoted field is never closed in {', '.join(sorted(unclosed)[:5])}.")
            line = F.rtrim(F.decode("record", charset), F.lit("\r\n"))
            rows = found_records.where(~F.col("head")).select(F.from_csv(line, schema.simpleString()[7:-1].replace(":", " "), options).alias("r")).select("r.*")
        else:
            # All fields of a line are looked at, or surplus ones would not show.
            rows = spark.read.schema(schema).options(**options).option("columnPruning", False).csv(
                list(d.files), header=True, enforceSchema=True, encoding=charset)
        # Spark marks lines with too few fields as well; those only have gaps at their end.
        bare = F.regexp_replace(_WHOLE_LINE, '"[^"]*"', "")
        fields = F.length(bare) - F.length(F.replace(bare, F.lit(d.delimiter), F.lit(""))) + 1
        order = range(len(names)) if d.header == first.header else [d.header.index(n) for n in first.header]
        parts.append(rows.select(
            *[_decoded(q(names[at]), d.encoding).alias(f"c{i}") for i, at in enumerate(order)],
            F.when(fields > len(names), _decoded(q(_WHOLE_LINE), d.encoding)).alias(_WHOLE_LINE)))
    return reduce(DataFrame.unionAll, parts)


def _checked(found: Sequence[Dialect]) -> Sequence[Dialect]:
    """Files may order the same columns differently; other differences are refused."""
    if not found:
        raise IngestError("The file is empty.")
    first = found[0]
    for d in found[1:]:
        if d.header != first.header and (sorted(d.header) != sorted(first.header) or len(set(d.header)) < len(d.header)):
            raise IngestError(f"The files have different columns: {', '.join(first.header)} and {', '.join(d.header)}.")
    return found


def surplus_lines(spark: SparkSession, path: str, extension: str = "csv") -> DataFrame:
    """``line`` for every record that has more fields than its file's header."""
    rows = _text_columns(spark, _checked(dialects(spark, path, "\t" if extension == "tsv" else None)))
    # A query of the marked line alone is refused, so the first field takes part in the test.
    return rows.where(F.col(_WHOLE_LINE).isNotNull() & (F.length(F.coalesce("c0", F.lit(""))) >= 0)).select(F.col(_WHOLE_LINE).alias("line"))


def read_delimited(spark: SparkSession, path: str, extension: str = "csv") -> tuple[DataFrame, list[tuple[str, str | None, str]]]:
    """A table with the exact header of its files, typed by its values.

    Every file is read by its own delimiter, encoding and header; columns are matched by name. Records
    may hold line breaks inside quotes. A record with surplus fields is an error that names it.
    """
    found = _checked(dialects(spark, path, "\t" if extension == "tsv" else None))
    notes: list[tuple[str, str | None, str]] = []
    for d in found:
        which = None if len(found) == 1 else ", ".join(PurePosixPath(f).name for f in d.files)
        notes += [("delimiter", which, d.delimiter), ("encoding", which, d.encoding)]
        if d.encoding != "utf-8":
            notes.append(("warning", which, f"not valid UTF-8; decoded as {d.encoding}"))
    table = _text_columns(spark, found)
    columns = [c for c in table.columns if c != _WHOLE_LINE]
    table = blank_tokens(table.select(*columns, F.col(_WHOLE_LINE).cast("binary").alias(_WHOLE_LINE)))
    line = F.col(_WHOLE_LINE).cast("string")
    typed, seen = infer_types(table, F.count(line).alias("surplus"), F.min(F.substring(line, 1, 200)).alias("example"))
    if seen["surplus"]:
        raise IngestError(f"{seen['surplus']} record(s) have more fields than the header, for example: {seen['example']}")
    return typed.toDF(*found[0].header), notes


def _first_character(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).select(F.trim(F.regexp_replace("value", "^﻿", "")).alias("v")).filter("v <> ''").limit(1).collect()
    return row[0]["v"][0] if row else ""


def _listed_records(spark: SparkSession, path: str) -> DataFrame | None:
    """The records of documents that are lists of objects, cut by many tasks and parsed as lines; None for any other list."""
    found, ends, stray = records(spark, path, JsonList())
    if stray or any(state != (False, -1) for state in ends.values()):
        return None
    # Outside strings a line break is white space, and inside them it is written otherwise.
    one_line = F.translate(F.col("record").cast("string"), "\r\n", "  ")
    rows = found.withColumn("value", F.ltrim(one_line, F.when(F.col("head"), "[, \t").otherwise(", \t")))
    seen = rows.agg(F.count("*").alias("n"), F.count_if(~F.col("value").startswith("{")).alias("other")).first()
    if not seen["n"] or seen["other"]:
        return None
    parts = [c for c in found.columns if c not in ("file", "head", "record")]
    folder = f"{shared_folder(spark).rstrip('/')}/json-records-{uuid.uuid4().hex}"
    rows.select("value", *[q(c) for c in parts]).write.partitionBy(*parts).text(folder)
    return spark.read.json(folder)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of records; an object that holds one list of records; or an object of columns.

    A list of objects is read by many tasks, whatever the size of its file. An object is one value of the
    format, so one task reads it whole: large tables belong in lists or in JSON Lines.
    """
    start = _first_character(spark, path)
    if start not in ("[", "{"):
        raise IngestError("A JSON table is written as a list of objects, or as an object of lists.")
    listed = _listed_records(spark, path) if start == "[" else None
    if listed is not None:
        if "_corrupt_record" in listed.columns:
            raise IngestError("A record of the JSON list is malformed.")
        return listed
    df = spark.read.json(path, multiLine=True)
    if "_corrupt_record" in df.columns:
        raise IngestError("The JSON text is malformed.")
    if start == "[":
        return df
    arrays = [f for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if len(arrays) == 1 and isinstance(arrays[0].dataType.elementType, T.StructType):
        return df.select(F.inline(q(arrays[0].name)))
    if not arrays:
        raise IngestError("A JSON table is written as a list of objects, or as an object of lists.")
    uneven = df.filter(F.size(F.array_distinct(F.array(*[F.size(q(f.name)) for f in arrays]))) > 1)
    if not uneven.isEmpty():
        raise IngestError("The columns of the JSON object have different lengths.")
    zipped = F.arrays_zip(*[q(f.name).alias(f"c{i}") for i, f in enumerate(arrays)])
    single = [f.name for f in df.schema.fields if f not in arrays]
    rows = df.select(*[q(c) for c in single], F.inline(zipped)).toDF(*single, *[f.name for f in arrays])
    return rows.select(*[q(f.name) for f in df.schema.fields])


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> tuple[DataFrame, list[tuple[str, str | None, str]]]:
    """Read a file or folder by its extension (or the given format), with notes on how it was read."""
    extension = (fmt or PurePosixPath(path).suffix.lstrip(".")).lower()
    if extension not in FORMATS:
        shown = ", ".join("." + e for e in FORMATS)
        raise IngestError(f"Unsupported file type '{extension or '(none)'}'. Supported: {shown}.")
    try:
        files = spark.read.format("binaryFile").load(path).select("length").agg(F.sum("length")).first()[0]
        if not files:
            raise IngestError("The file is empty.")
        if extension == "parquet":
            return spark.read.parquet(path), []
        if extension == "jsonl":
            return flatten(spark.read.json(path)), []
        if extension == "json":
            return flatten(read_json(spark, path)), []
        return read_delimited(spark, path, extension)
    except AnalysisException as error:
        raise IngestError(f"Reading {extension} failed: {str(error)[:200]}") from error


def ingest(spark: SparkSession, path: str, destination: str | None = None, fmt: str | None = None) -> Ingested:
    """Read, normalise and (optionally) store as Parquet; later stages read the stored table only."""
    table, notes = read_table(spark, path, fmt)
    done = normalize(table)
    sources = fingerprint(spark, path).select(
        F.lit("source").alias("step"), F.col("path").alias("column"),
        F.concat_ws(" ", F.col("bytes").cast("string"), F.coalesce("sha256", F.concat(F.lit("tree:"), "tree_sha256"))).alias("detail"))
    report = spark.createDataFrame(notes, REPORT).unionByName(done.report).unionByName(sources)
    if destination:
        write_table(done.table, destination)
        return Ingested(spark.read.parquet(destination), report)
    return Ingested(done.table, report)


def columns_of_table(spark: SparkSession, path: str) -> list[str]:
    """Column names from the schema alone."""
    return spark.read.parquet(path).columns


def load_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the named columns; the scan reads nothing else."""
    return spark.read.parquet(path).select(*[q(c) for c in columns])
