"""Exact duplicates through an extendible-hash index on shared files."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.joins import counted
from tablewright.llm.text import SPACES, whole, without
from tablewright.session import written

BUCKET_ROWS = 50_000
MOST_BITS = 20  # the directory has at most 2 ** 20 cells, whatever the corpus
BROADCAST_BITS = 14


def directory(pages: DataFrame, bits: int, capacity: int) -> DataFrame:
    """Which bucket holds each cell of ``bits`` leading hash bits: ``cell``, ``depth``, ``bucket``.

    Doubling from depth 0 splits every bucket that holds more rows than the capacity. A bucket's
    count at each depth is the sum over its cells, so the depth where a cell comes to rest is the
    first at which its prefix is not overfull; one that stays overfull at the last depth keeps its
    rows in a chain. A bucket is named by its first cell and so is a range of keys.
    """
    cells = pages.groupBy(F.shiftrightunsigned("__h", 64 - bits).alias("cell")).agg(F.count("*").alias("n"))
    depths = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(bits))))
    depths = depths.withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    sizes = depths.groupBy("depth", "prefix").agg(F.sum("n").alias("rows"))
    resting = depths.drop("n").join(sizes, ["depth", "prefix"])
    resting = resting.where((F.col("rows") <= capacity) | (F.col("depth") == bits))
    return resting.groupBy("cell").agg(F.min("depth").alias("depth")).withColumn(
        "bucket", F.expr(f"shiftleft(shiftright(cell, {bits} - depth), {bits} - depth)"))


def _marked(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``docs`` with key, characters, hash and digest of each row; texts count without white space."""
    value = whole(F.col(text))
    bare = without(value, SPACES)
    return docs.select("*", F.col(key).alias("__key"), F.length(value).cast("bigint").alias("__chars"),
                       F.xxhash64(bare).alias("__h"), F.sha2(bare, 256).alias("__sha"))


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = BUCKET_ROWS):
    """The pages of the index (a row's key, hash and digest) and its entries (one per distinct text).

    Both are tables on shared files. Owner tasks hold whole buckets. A hash that occurs once has
    nothing to be compared with. The texts of the others are compared byte for byte, by grouping on the
    text itself, combined per task first, so a group of copies reaches its owner as one row per task;
    different texts of one hash stand in a chain.
    """
    marked = _marked(docs, text, key)
    pages = written(marked.select("__key", "__chars", "__h", "__sha"), "pages")
    rows = pages.count()
    bits = min(MOST_BITS, max(1, math.ceil(math.log2(max(1, rows / capacity))) + 3))
    cells = written(directory(pages, bits, capacity), "directory")
    cells = F.broadcast(cells) if bits <= BROADCAST_BITS else cells
    counts = pages.groupBy("__h").agg(F.count("*").alias("n"))
    repeated = written(counts.where("n > 1").select("__h"), "repeated")
    best = F.min(F.struct((-F.col("__chars")).alias("c"), F.col("__key").isNull().alias("n"), F.col("__key").alias("k"))).alias("__best")

    def placed(frame: DataFrame) -> DataFrame:
        return frame.withColumn("cell", F.shiftrightunsigned("__h", 64 - bits)).join(cells, "cell")

    small = counted(repeated)
    texts = marked.select("__key", "__chars", "__h", "__sha", without(whole(F.col(text)), SPACES).alias("__bare")).join(small, "__h", "left_semi")
    several = placed(texts).groupBy("bucket", "__h", "__bare").agg(
        F.first("__sha").alias("text_sha256"), F.count("*").alias("group_size"), best).drop("__bare")
    # A hash that occurs once is its own group: no row is gathered for it.
    single = placed(pages.join(small, "__h", "left_anti")).select(
        "bucket", "__h", F.col("__sha").alias("text_sha256"), F.lit(1).cast("bigint").alias("group_size"),
        F.struct((-F.col("__chars")).alias("c"), F.col("__key").isNull().alias("n"), F.col("__key").alias("k")).alias("__best"))
    chain = Window.partitionBy("bucket", "__h").orderBy("text_sha256")
    entries = several.unionByName(single).withColumn("chain", F.row_number().over(chain))
    entries = entries.select("bucket", "__h", "chain", "text_sha256", "group_size", F.col("__best.k").alias("keep_id"),
                             (-F.col("__best.c")).alias("__keep_chars"))
    return pages, written(entries.sortWithinPartitions("bucket", "__h", "chain"), "entries")


def _is_best(key: str = "__key") -> Column:
    return F.col(key).eqNullSafe(F.col("keep_id")) & (F.col("__chars") == F.col("__keep_chars"))


def _found(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("__h").alias("__eh"), "text_sha256", "group_size", "keep_id", "__keep_chars")


_SAME_ENTRY = "__h = __eh AND __sha = text_sha256"


def _repeats(pages: DataFrame) -> bool:
    """Whether any row repeats key and text alike."""
    return not pages.groupBy("__key", "__h", "__sha", "__chars").count().where("count > 1").isEmpty()


def _first_of_repeats(rows: DataFrame) -> Column:
    """Of rows that repeat key and text, the first by a hash of all their columns."""
    order = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    return F.row_number().over(Window.partitionBy("__key", "__h", "__sha", "__chars").orderBy(order)) == 1


def mark_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Of equal texts the row with the most characters stays, then the smallest key, nulls last; of
    rows that repeat text and key alike exactly one stays. A null text is an empty one, and all
    empty texts are one group. An empty table gives no rows. Columns of ``docs`` with one of the four
    names are replaced, names that begin with two underscores are left out.
    """
    docs = _given(docs)
    pages, entries = build_index(docs, text, key, capacity)
    joined = _marked(docs, text, key).join(_found(entries), F.expr(_SAME_ENTRY))
    kept = _is_best()
    if _repeats(pages):
        kept = kept & _first_of_repeats(joined)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def _given(docs: DataFrame) -> DataFrame:
    added = ("keep_id", "group_size", "kept", "text_sha256")
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added and not c.startswith("__")])


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = BUCKET_ROWS) -> DataFrame:
    """One row of every group of equal texts, with the columns of ``docs`` (as :func:`mark_copies` takes them).

    Only the marks of the rows that go are joined back, so the texts stay where they are while those
    marks are few enough for every task.
    """
    docs = _given(docs)
    pages, entries = build_index(docs, text, key, capacity)
    gone = pages.join(_found(entries), F.expr(_SAME_ENTRY)).where(~_is_best())
    gone = counted(written(gone.select(F.col("__key").alias("__gk"), F.col("__h").alias("__gh"), F.col("__chars").alias("__gc")).distinct(), "gone"))
    rows = _marked(docs, text, key)
    rows = rows.join(gone, F.col("__key").eqNullSafe(F.col("__gk")) & (F.col("__h") == F.col("__gh")) & (F.col("__chars") == F.col("__gc")), "left_anti")
    if _repeats(pages):
        rows = rows.withColumn("__first", _first_of_repeats(rows)).where("__first")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
