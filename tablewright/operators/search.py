"""Ranked text search over a corpus DataFrame, keyword routing and rule lookup.

A search touches only the postings of the queries' terms, which lie in blocks of documents. A block
that cannot hold one of the k best documents, by the greatest weight of each term in it, is not scored.
The result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.kinds import q
from tablewright.operators.matching import containing
from tablewright.session import checkpoint, spread, written

# Fixed values.
K1, B = 1.5, 0.75
TOP = 3
MIN_WORD = 3
BLOCK_DOCS = 1_024
QUERY_TERMS = 500_000  # terms, query by query, of one block of queries
NAME_WEIGHT, KEYWORD_WEIGHT, FIELD_WEIGHT = 10, 3, 1


def words(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores, longer than two characters."""
    spaced = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ")
    return F.filter(F.split(spaced, " "), lambda w: F.length(w) >= MIN_WORD)


def fields_text(columns: Sequence[str]) -> Column:
    """The search columns of a row as one text."""
    return F.concat_ws(" ", *[F.coalesce(q(c).cast("string"), F.lit("")) for c in columns])


def idf(documents: int, containing_: Column) -> Column:
    return F.log((documents - containing_ + 0.5) / (containing_ + 0.5) + 1)


def term_statistics(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """``(term, df, idf)`` of every word of the corpus."""
    documents = docs.count()
    docs = spread(docs.select(text.alias("__text")), documents)
    text = F.col("__text")
    terms = docs.select(F.explode(F.array_distinct(words(text))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select(
        "term", "df", F.round(idf(documents, F.col("df")), 6).alias("idf"))


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """``(query, term, repeats)``: a repeated word counts as often as it is written."""
    exploded = queries.select(q(key).alias("query"), F.explode(words(q(text))).alias("term"))
    return exploded.groupBy("query", "term").agg(F.count(F.lit(1)).alias("repeats"))


def _posting_blocks(docs: DataFrame, vocabulary: Sequence[str], block_docs: int) -> DataFrame:
    """The documents (doc, w: their words) in blocks: keys, lengths, and per document the asked terms with their counts.

    A term of very many documents is spread over all blocks. Words are counted in their row: nothing is exploded.
    """
    kind = docs.schema["doc"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(list(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shared.value)}
        for batch in batches:
            for first in range(0, batch.num_rows, block_docs):
                part = batch.slice(first, block_docs)
                w = part.column("w")
                lengths = np.diff(w.offsets.to_numpy())
                coded = w.flatten().dictionary_encode()
                known = np.array([number.get(t, -1) for t in coded.dictionary.to_pylist()] or [-1], np.int64)
                term = known[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
                owner = np.repeat(np.arange(len(lengths)), lengths)[term >= 0]
                pair, tf = np.unique(owner * len(number) + term[term >= 0], return_counts=True)
                sizes = np.bincount(pair // max(1, len(number)), minlength=len(lengths))
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc")),
                     *[pa.array([v.tolist()], pa.list_(pa.int32())) for v in (lengths, sizes, pair % max(1, len(number)), tf)]],
                    ["docs", "lengths", "sizes", "terms", "tf"])
    return docs.mapInArrow(run, f"docs array<{kind}>, lengths array<int>, sizes array<int>, terms array<int>, tf array<int>")


class _Best:
    """The best k documents of one query so far, by the rounded score and then by document."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def bar(self) -> float:
        return self.rows[-1][2] if len(self.rows) == self.k else 0.0

    def add(self, docs: Sequence, scores: np.ndarray) -> None:
        fit = np.flatnonzero(scores >= max(self.bar - 1e-8, 1e-300))
        if len(fit) > 4 * self.k:  # ties with the k-th stay
            least = np.partition(scores[fit], len(fit) - self.k)[len(fit) - self.k]
            fit = fit[scores[fit] >= least - 1e-8]
        new = [(-round(float(scores[i]), 9), (docs[i] is not None, docs[i]), float(scores[i]), docs[i]) for i in fit.tolist()]
        self.rows = sorted(self.rows + new, key=lambda r: r[:2])[:self.k]


def _scored_blocks(index: DataFrame, asked: Sequence[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, mean: float, k: int, prune: bool) -> DataFrame:
    """``(at, doc, score, read, skipped)``: the best k of every task for each query, and how many blocks it opened for it.

    A block's maximum for a query is the sum of its terms' greatest weights in the block; below the task's k-th score it stays closed.
    """
    kind = index.schema["docs"].dataType.elementType.simpleString()
    shared = index.sparkSession.sparkContext.broadcast((list(asked), weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, idfs = shared.value
        best, read, skipped = [_Best(k) for _ in queries], [0] * len(queries), [0] * len(queries)
        docs_kind = None
        for batch in batches:
            docs_kind = batch.schema.field("docs").type.value_type
            for r in range(batch.num_rows):
                docs = batch.column("docs")[r].as_py()
                lengths, sizes, terms, tf = (np.array(batch.column(c)[r].as_py(), np.int64) for c in ("lengths", "sizes", "terms", "tf"))
                norm = K1 * (1 - B + B * lengths / (mean or 1.0))
                part = idfs[terms] * tf * (K1 + 1) / (tf + np.repeat(norm, sizes))
                most = np.zeros(len(idfs))
                np.maximum.at(most, terms, part)
                stops = np.cumsum(sizes)
                for i, (at, repeats) in enumerate(queries):
                    bound = float((most[at] * repeats).sum())
                    if bound <= 0 or (prune and bound < best[i].bar * (1 - 1e-9)):
                        skipped[i] += 1
                        continue
                    read[i] += 1
                    dense = np.zeros(len(idfs))
                    dense[at] = repeats
                    sums = np.concatenate([[0.0], np.cumsum(dense[terms] * part)])
                    near = np.flatnonzero(sums[stops] - sums[stops - sizes] >= best[i].bar - 1e-6)
                    if len(near) > 4 * k:
                        rough = (sums[stops] - sums[stops - sizes])[near]
                        near = near[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-6]
                    # Running sums are rough in their last digits: the documents that count are added up on their own.
                    exact = np.array([(dense[terms[e - z:e]] * part[e - z:e]).sum() for e, z in zip(stops[near].tolist(), sizes[near].tolist())])
                    best[i].add([docs[d] for d in near.tolist()], exact)
        rows = [(i, d, s) for i, b in enumerate(best) for _, _, s, d in b.rows]
        counts = [(i, a, b) for i, (a, b) in enumerate(zip(read, skipped)) if a or b]
        at, doc, score = list(zip(*rows)) or [()] * 3
        also, opened, closed = list(zip(*counts)) or [()] * 3
        if docs_kind is not None:
            n, m = len(at), len(also)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*at, *also], pa.int32()), pa.concat_arrays([pa.array(doc, docs_kind), pa.nulls(m, docs_kind)]),
                 pa.array([*score, *[None] * m], pa.float64()), pa.array([*[0] * n, *opened], pa.int64()), pa.array([*[0] * n, *closed], pa.int64())],
                ["at", "doc", "score", "read", "skipped"])
    return index.mapInArrow(run, f"at int, doc {kind}, score double, read bigint, skipped bigint")


def _top(scores: DataFrame, k: int) -> DataFrame:
    """The best k per query: Spark keeps k per task before the shuffle, however many documents a query has.

    Equal documents may differ in the last digits, by the order their parts were added in, so the
    order is by the rounded score and then by document."""
    best = Window.partitionBy("at").orderBy(F.round("score", 9).desc(), "doc")
    return scores.filter("score > 0").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _search_blocks(docs: DataFrame, key: str, text: Column, queries: DataFrame, query_key: str, query_text: str, k: int,
                   prune: bool, block_docs: int) -> list[tuple[DataFrame, DataFrame]]:
    """Per block of queries the task's best documents, and the queries by number."""
    docs = spread(docs.select(q(key).alias("doc"), text.alias("__text")), docs.count())
    docs = docs.select("doc", words(F.col("__text")).alias("w"))
    asked = query_terms(queries, query_key, query_text)
    asked = written(asked.groupBy("query").agg(F.collect_list("term").alias("terms"), F.collect_list("repeats").alias("repeats")), "asked")
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks, out = math.ceil(total / QUERY_TERMS), []
    kind = queries.schema[query_key].dataType
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query", "terms"), F.lit(blocks)) == b).collect()  # about QUERY_TERMS terms
        vocabulary = sorted({t for r in rows for t in r["terms"]})
        number = {t: i for i, t in enumerate(vocabulary)}
        index = written(_posting_blocks(docs, vocabulary, block_docs), "posting-blocks")
        documents, length = index.agg(F.sum(F.size("docs")), F.sum(F.expr("aggregate(lengths, 0L, (a, n) -> a + n)"))).first()
        if not documents:
            continue
        # At most one row per asked term.
        holding = np.zeros(len(vocabulary))
        for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            holding[r["t"]] = r["count"]
        weight = np.log((documents - holding + 0.5) / (holding + 0.5) + 1)
        pairs = [(np.array([number[t] for t in r["terms"]]), np.array(r["repeats"], float)) for r in rows]
        names = docs.sparkSession.createDataFrame(
            [(i, r["query"]) for i, r in enumerate(rows)], T.StructType([T.StructField("n", T.IntegerType()), T.StructField("query", kind)]))
        out.append((_scored_blocks(index, pairs, weight, length / documents, k, prune), names))
    return out


def bm25(docs: DataFrame, key: str, text: Column, queries: DataFrame, query_key: str, query_text: str,
         k: int = TOP, prune: bool = True, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``(query, doc, score, rank)``: the k best documents per query, ties in document order.

    The asked words' postings are written once, in blocks of documents. ``prune=False`` opens every block; it is there to
    check the pruned plan by. Queries go through in blocks of bounded size.
    """
    found = [_top(scores, k).join(F.broadcast(names), F.col("at") == F.col("n")).select("query", "doc", "score", "rank")
             for scores, names in _search_blocks(docs, key, text, queries, query_key, query_text, k, prune, block_docs)]
    if not found:
        empty = docs.select(F.lit(None).cast(queries.schema[query_key].dataType).alias("query"), q(key).alias("doc"))
        return empty.where("false").select("query", "doc", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    return reduce(DataFrame.unionAll, found)


def blocks_opened(docs: DataFrame, key: str, text: Column, queries: DataFrame, query_key: str, query_text: str, k: int = TOP,
                  block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``(query, read, skipped)``: for how many blocks of documents the postings were read, and how many their maximum ruled out."""
    found = [scores.groupBy("at").agg(F.sum("read").alias("read"), F.sum("skipped").alias("skipped")).join(
        F.broadcast(names), F.col("at") == F.col("n")).select("query", "read", "skipped")
        for scores, names in _search_blocks(docs, key, text, queries, query_key, query_text, k, True, block_docs)]
    return reduce(DataFrame.unionAll, found)


def search_fields(table: DataFrame, key: str, search_columns: Sequence[str], output_columns: Sequence[str],
                  queries: DataFrame, query_key: str, query_text: str, k: int = TOP) -> DataFrame:
    """Search some columns of a table and return others, best rows first."""
    hits = bm25(table, key, fields_text(search_columns), queries, query_key, query_text, k)
    shown = table.select(q(key).alias("doc"), *[q(c) for c in output_columns])
    return hits.join(shown, "doc").select("query", "rank", "doc", *[q(c) for c in output_columns])


def multi_search(domains: Mapping[str, Mapping], queries: DataFrame, query_key: str, query_text: str,
                 priority: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Search several domains at once: ``(domain, query, rank, doc, score)``.

    Each domain names its ``table``, ``key``, ``columns`` and ``k``. Priority words of a domain
    (its first two) are added to the query there.
    """
    parts = []
    for name, domain in domains.items():
        extra = " ".join((priority or {}).get(name, [])[:2])
        asked = queries.select(q(query_key).alias("query_key"), F.concat_ws(" ", q(query_text), F.lit(extra)).alias("query_text"))
        hits = bm25(domain["table"], domain["key"], fields_text(domain["columns"]), asked, "query_key", "query_text", domain["k"])
        parts.append(hits.select(F.lit(name).alias("domain"), "query", "rank", "doc", "score"))
    return reduce(DataFrame.unionByName, parts)


# -- routing and rules ---------------------------------------------------------------------


def whole_word_hits(text: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords occur as whole words or phrases."""
    def one(word: str) -> Column:
        quoted = "".join(f"\\{ch}" if not ch.isalnum() and not ch.isspace() else ch for ch in word.lower())
        return F.lower(text).rlike(rf"(?U)\b{quoted}\b").cast("int")
    return sum((one(w) for w in keywords[1:]), one(keywords[0])) if keywords else F.lit(0)


def route(text: Column, domains: Mapping[str, Sequence[str]], default: str) -> Column:
    """The domain with the most keyword hits (the first of equals), or the default without any.

    The keywords are configuration, so they are part of the expression and nothing is joined.
    """
    scored = [
        F.struct(whole_word_hits(text, keywords).alias("hits"), F.lit(-i).alias("order"), F.lit(name).alias("name"))
        for i, (name, keywords) in enumerate(domains.items())
    ]
    best = F.array_max(F.array(*scored))
    return F.when(best["hits"] > 0, best["name"]).otherwise(default)


def rule_lookup(categories: DataFrame, rules: DataFrame, category: str, rule: str, order: str) -> DataFrame:
    """For each distinct category the rule that fits best: ``(category, rule, tier)``.

    Tier 1 is an equal name, tier 2 containment either way, tier 3 any keyword of the rule
    contained in the category; inside a tier the first rule wins.
    """
    # Both tables enter several branches; each is computed once.
    wanted = checkpoint(categories.select(q(category).alias("category")).distinct().withColumn("c", F.lower("category")))
    known = checkpoint(rules.select(q(rule).alias("rule"), q(order).alias("at")).withColumn("r", F.lower("rule")))
    # Of rules with one lower-case name only the first can win.
    first = known.groupBy("r").agg(F.min(F.struct("at", "rule")).alias("best"))
    names, needles = wanted.select("c").distinct(), first.select("r", "best.at", "best.rule")
    equal = names.join(needles, F.col("c") == F.col("r")).select("c", F.lit(1).alias("tier"), "at", "rule")
    inside = containing(names, needles, "c", "r").select("c", F.lit(2).alias("tier"), "at", "rule")
    around = containing(needles, names, "r", "c").select("c", F.lit(2).alias("tier"), "at", "rule")
    keyword = known.select("at", "rule", F.explode(F.split(F.trim(F.regexp_replace("r", r"[/\-\s]+", " ")), " ")).alias("w"))
    keyword = keyword.filter("w <> ''").groupBy("w").agg(F.min(F.struct("at", "rule")).alias("best"))
    by_word = containing(names, keyword, "c", "w").select("c", F.lit(3).alias("tier"), "best.at", "best.rule")
    found = reduce(DataFrame.unionByName, [equal, inside, around, by_word])
    best = found.groupBy("c").agg(F.min(F.struct("tier", "at", "rule")).alias("best"))
    return wanted.join(best, "c", "left").select("category", "best.rule", "best.tier")


def best_match(results: DataFrame, query: str, rank: str, name: str, keywords: str, fields: Sequence[str],
               priorities: Sequence[str]) -> DataFrame:
    """One row per query: the first result whose name meets a priority word (in the words' order), else the
    one whose fields hold most priority words (name 10, keywords 3, any field 1), else the first."""
    wanted = [p.lower().strip() for p in priorities]
    label, words_, rest = F.lower(q(name)), F.lower(q(keywords)), F.lower(F.concat_ws(" ", *[q(f) for f in fields]))
    meets = [F.when(label.contains(p) | F.lit(p).contains(label), i) for i, p in enumerate(wanted)]
    first = F.least(*meets, F.lit(len(wanted)), F.lit(len(wanted))) if meets else F.lit(0)
    points = sum((
        F.when(label.contains(p), NAME_WEIGHT).when(words_.contains(p), KEYWORD_WEIGHT)
        .when(rest.contains(p), FIELD_WEIGHT).otherwise(0)
        for p in wanted), F.lit(0))
    order = Window.partitionBy(q(query)).orderBy(first, F.desc(points), q(rank))
    return results.withColumn("points", points).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
