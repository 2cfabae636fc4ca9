"""The best documents for each item of a query set, by presence masks.

1. One pass over the documents counts their terms and keeps what the items ask for: per document its
   length and the asked terms with how often they occur. That table is written once.
2. Weights follow from its document counts.
3. Each task goes through its documents in blocks. A block holds one bitmap per asked term; for an item, the
   bitmaps of its terms, read across, give every document the mask of terms it matches. Documents of one mask are a group.
   A mask's maximum is the sum of its terms' weights at their greatest part in the block. Masks are evaluated from the
   highest maximum down, until the next one is below the task's k-th best score so far.
4. The best k of every task meet in one window per item.

Items are asked in blocks of bounded size, each of them one pass over all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import written

# Fixed values of the contract.
TOP = 10
TERM_BYTES = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum())
SCALE, WEIGHT_SCALE, LENGTH_SHARE, TF_SCALE, NORM_SCALE = 1_000_000_000, 1000, 75, 1000, 8

ITEM_TERMS = 500_000  # distinct terms, item by item, of one block of items
BLOCK_DOCS = 4_096
BLOCK_BYTES = 64_000_000  # of unpacked bitmaps
STEP_DOCS = 64  # documents that are scored at once

_CLEAN = bytes((b + 32 if 65 <= b <= 90 else b) if b in TERM_BYTES else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of letters, digits and all that is not ASCII, with A-Z lowered."""
    return text.translate(_CLEAN).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * holding + 1)))


def norm(length: int, documents: int, total: int) -> int:
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * length * documents) // total


def _values(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


# -- the items -----------------------------------------------------------------------------


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """``(item, terms, repeats)``: the distinct terms of each item that has any, and how often it holds them."""
    kind = items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(terms(t)) for t in _values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), pa.array([list(c) for c in counts], pa.list_(pa.binary())),
                 pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))], ["item", "terms", "repeats"])
    plain = items.select(F.col(f"`{key}`").alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    return plain.mapInArrow(run, f"item {kind}, terms array<binary>, repeats array<bigint>").where(F.size("terms") > 0)


def item_blocks(asked: DataFrame, most: int = ITEM_TERMS) -> list[DataFrame]:
    """The items in blocks of about ``most`` terms; an item of more terms may make its block larger."""
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = math.ceil(total / most)
    dealt = F.pmod(F.xxhash64("item", "terms"), F.lit(blocks))
    return [asked.where(dealt == b) for b in range(blocks)]


# -- the documents -------------------------------------------------------------------------


def asked_postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``(doc, n, at, tf)`` of each row with a term: its length, and places in the vocabulary, rising, with their counts."""
    kind = docs.schema["doc"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shared.value)}
        for batch in batches:
            kept, sizes, at, tf, edges = [], [], [], [], [0]
            for row, text in enumerate(_values(batch.column("text"))):
                words = terms(text)
                if not words:
                    continue
                found = Counter(filter(None.__ne__, map(number.get, words)))
                kept.append(row)
                sizes.append(len(words))
                places = sorted(found)
                at += places
                tf += [found[p] for p in places]
                edges.append(len(at))
            offsets = pa.array(edges, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))], ["doc", "n", "at", "tf"])
    return docs.mapInArrow(run, f"doc {kind}, n bigint, at array<int>, tf array<bigint>")


class Block:
    """Documents of a task with the bitmaps of all asked terms."""

    def __init__(self, order: list, sizes: np.ndarray, at: np.ndarray, parts: np.ndarray, vocabulary: int):
        self.order, self.at, self.parts = order, at, parts
        self.edges = np.concatenate([[0], np.cumsum(sizes)])
        # One bitmap per term: bit d is set if document d holds it. Terms that no document holds have none.
        self.seen, row = np.unique(at, return_inverse=True)
        docs = np.repeat(np.arange(len(sizes)), sizes)
        self.bitmaps = np.zeros((len(self.seen), -(-len(sizes) // 8)), np.uint8)
        np.bitwise_or.at(self.bitmaps, (row, docs >> 3), (1 << (docs & 7)).astype(np.uint8))
        self.most = np.zeros(len(self.seen), np.int64)
        np.maximum.at(self.most, row, parts)
        self.row = np.full(vocabulary, -1, np.int64)
        self.row[self.seen] = np.arange(len(self.seen))

    def masks(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each distinct mask over the given terms (one row of 0 and 1), and the mask of every document."""
        bits = np.unpackbits(self.bitmaps[rows], axis=1, count=len(self.order), bitorder="little")
        packed = np.packbits(bits, axis=0, bitorder="little").T
        wide = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), np.uint8)
        wide[:, :packed.shape[1]] = packed
        words = wide.view("<u8")
        if words.shape[1] == 1:
            distinct, group = np.unique(words[:, 0], return_inverse=True)
            distinct = distinct[:, None]
        else:
            distinct, group = np.unique(words, axis=0, return_inverse=True)
        masks = np.unpackbits(np.ascontiguousarray(distinct).view(np.uint8), axis=1, count=len(rows), bitorder="little")
        return masks, group.reshape(-1)

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of some documents; ``weights`` has one entry per asked term, 0 for those the item lacks."""
        sizes = self.edges[docs + 1] - self.edges[docs]
        stops = np.cumsum(sizes)
        spots = np.arange(stops[-1] if len(stops) else 0) + np.repeat(self.edges[docs] - (stops - sizes), sizes)
        sums = np.concatenate([[0], np.cumsum(weights[self.at[spots]] * self.parts[spots])])
        return sums[stops] - sums[stops - sizes]


Best = list[tuple[int, tuple, object]]  # minus the score, the document's place in the order, the document


def evaluate(block: Block, item: tuple[np.ndarray, np.ndarray], vocabulary: int, best: Best, k: int) -> Best:
    """The best k of ``best`` and a block's documents: masks from the highest maximum down, until no other can reach the k-th score."""
    at, weights = item
    rows = block.row[at]
    at, weights, rows = at[rows >= 0], weights[rows >= 0], rows[rows >= 0]
    most = weights * block.most[rows]
    bar = -best[-1][0] if len(best) == k else 1
    # Without a document that can reach the bar nothing is grouped.
    if int(most.sum()) < bar:
        return best
    masks, group = block.masks(rows)
    top = masks.astype(np.int64) @ most
    members = np.argsort(group, kind="stable")
    edges = np.searchsorted(group[members], np.arange(len(masks) + 1))
    dense = np.zeros(vocabulary, np.int64)
    dense[at] = weights
    waiting: list[np.ndarray] = []
    size = 0
    order = np.argsort(-top, kind="stable").tolist()
    for i, m in enumerate(order):
        if top[m] < bar:
            break
        waiting.append(members[edges[m]:edges[m + 1]])
        size += len(waiting[-1])
        if size >= STEP_DOCS or i + 1 == len(order) or top[order[i + 1]] < bar:
            docs = np.concatenate(waiting)
            scores = block.scores(docs, dense)
            fit = scores >= bar
            best = sorted(best + [(-s, *block.order[d]) for s, d in zip(scores[fit].tolist(), docs[fit].tolist())], key=lambda b: b[:2])[:k]
            bar = -best[-1][0] if len(best) == k else 1
            waiting, size = [], 0
    return best


def _place(doc) -> tuple:
    return (doc is None, 0 if doc is None else doc)


def best_documents(postings: DataFrame, items: list[tuple], vocabulary: int, statistics: tuple[int, int, dict[int, int]],
                   k: int, block_docs: int) -> DataFrame:
    """``(item, doc, score)``: the best k of every task for each item. ``items`` holds (item, places of its terms, repeats)."""
    documents, total, holding = statistics
    kind = postings.schema["doc"].dataType.simpleString()
    weights = {t: weight(documents, df) for t, df in holding.items()}
    held = []
    for i, (_, at, repeats) in enumerate(items):
        pairs = [(t, weights[t] * r) for t, r in zip(at, repeats) if weights.get(t, 0) > 0]
        if pairs:
            held.append((i, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], np.int64)))
    shared = postings.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {i: [] for i, _, _ in shared.value}
        widest = max((len(at) for _, at, _ in shared.value), default=1)
        step = max(8, min(block_docs, BLOCK_BYTES // widest))
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                at, tf = part.column("at"), part.column("tf")
                sizes = np.diff(at.offsets.to_numpy())
                flat, count = at.flatten().to_numpy(), tf.flatten().to_numpy()
                m = np.array([norm(n, documents, total) for n in part.column("n").to_pylist()], np.int64)
                parts = SCALE * count // (TF_SCALE * count + NORM_SCALE * np.repeat(m, sizes))
                block = Block([(_place(d), d) for d in part.column("doc").to_pylist()], sizes, flat, parts, vocabulary)
                for i, places, w in shared.value:
                    best[i] = evaluate(block, (places, w), vocabulary, best[i], k)
        rows = [(i, d, -s) for i, found in best.items() for s, _, d in found]
        i, doc, score = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(doc, kinds), pa.array(score, pa.int64())], ["at", "doc", "score"])

    kinds = pa.string() if kind == "string" else pa.int64()
    return postings.mapInArrow(run, f"at int, doc {kind}, score bigint")


def _one_block(docs: DataFrame, items: DataFrame, k: int, block_docs: int) -> DataFrame:
    rows = items.collect()  # of bounded size, see item_blocks
    vocabulary = sorted({bytes(t) for r in rows for t in r["terms"]})
    number = {t: i for i, t in enumerate(vocabulary)}
    postings = written(asked_postings(docs, vocabulary), "asked-postings")
    documents, total = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # At most one row per asked term.
    holding = {r["t"]: r["df"] for r in postings.select(F.explode("at").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
    asked = [(r["item"], [number[bytes(t)] for t in r["terms"]], r["repeats"]) for r in rows]
    found = best_documents(postings, asked, len(vocabulary), (documents, total, holding), k, block_docs)
    order = Window.partitionBy("at").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = items.sparkSession.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], f"i int, item {items.schema['item'].dataType.simpleString()}")
    return ranked.join(F.broadcast(names), F.col("at") == F.col("i")).select("item", "rank", "doc", "score")


def search(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id",
           k: int = TOP, block_docs: int = BLOCK_DOCS, block_terms: int = ITEM_TERMS) -> DataFrame:
    """The ``k`` best rows of ``docs`` for each row of ``items``: item's key, ``rank`` from 1, document's key and ``score`` above 0.

    Equal scores stand in the order of the keys, nulls last; rows that share a key are several documents
    and may both be found. Items that share a key are several items, each with ranks of its own. A null text has no terms: as an item it
    finds nothing, as a document it is not found and does not count. Without items or documents there are no rows.
    Other columns are not looked at. Document keys are integers or text.
    """
    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select((F.col(f"`{key}`") if kind == "string" else F.col(f"`{key}`").cast("bigint")).alias("doc"),
                        F.col(f"`{text}`").cast("string").alias("text"))
    asked = written(item_terms(items, item_key, item_text), "asked-items")
    parts = [_one_block(plain, block, k, block_docs) for block in item_blocks(asked, block_terms)]
    if not parts:
        parts = [asked.select("item", F.lit(1).alias("rank"), F.lit(None).cast(plain.schema["doc"].dataType).alias("doc"),
                              F.lit(0).cast("bigint").alias("score")).where("false")]
    return reduce(DataFrame.unionAll, parts).withColumnsRenamed({"item": item_key, "doc": key})
