"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tablewright.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    split = [(d, terms(t)) for d, t in docs]
    n_docs, total = sum(bool(w) for _, w in split), sum(len(w) for _, w in split)
    df = Counter(t for _, w in split for t in set(w))
    out = []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for doc, w in split:
            if w:
                m = 25 + 75 * len(w) * n_docs // total
                tf = Counter(w)
                score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * tf[t] // (1000 * tf[t] + 8 * m))
                            for t, r in asked.items() if tf[t])
                if score > 0:
                    found.append((-score, doc is None, doc))
        out += [(item, i, doc, -s) for i, (s, _, doc) in enumerate(sorted(found, key=lambda f: f[:2] + (f[2] or 0,))[:k], 1)]
    return sorted(out, key=str)


def check(docs, items, **options):
    got = sorted(map(tuple, ranked.search(docs, items, **options).collect()), key=str)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert got == want
    return want


def test_terms():
    text = "It's ÉCOLE_no.7, K x\x00y\x7fz İ 😀"
    assert [t.decode() for t in ranked.terms(text.encode())] == terms(text)


def test_whole_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(5)
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    want = check(docs, items)
    assert len({r[0] for r in want}) == items.count()


def planted(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(150)]
    draw_text = lambda n: " ".join(vocabulary[min(int(draw.expovariate(.05)), 149)] for _ in range(n))
    docs = [(i, draw_text(draw.randrange(1, 60))) for i in draw.sample(range(-50, 500), 250)]
    copies = [(600 + i, docs[3][1]) for i in range(40)]  # equal scores
    docs += copies + [(None, docs[5][1]), (None, docs[5][1]), (700, docs[5][1]), (700, docs[5][1]), (701, None), (702, ""), (703, "?! --"),
                      (704, "w3 " * 30_000), (705, " ".join(vocabulary))]
    items = [(i, draw_text(draw.randrange(1, 12))) for i in range(15)]
    # More terms than one machine word of a mask has, no terms, unknown terms, a repeated and a null key.
    items += [(20, " ".join(vocabulary)), (21, None), (22, "..."), (23, "nowhere"), (3, "w3 w3 w100"), (None, "W7 w7, w90")]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_planted(spark, seed):
    docs, items = planted(seed)
    docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS at", "2 AS rank", "3 AS item_id").repartition(4)
    items = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS terms")
    want = check(docs, items)
    assert max(r[1] for r in want) == 10
    check(docs, items, block_docs=16, block_terms=40)  # many blocks of documents and of items


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (2, None)], "item_id long, text string")
    nothing = "doc_id long, text string"
    assert ranked.search(spark.createDataFrame([], nothing), items).collect() == []
    assert ranked.search(docs.where("doc_id = 2"), items).collect() == []
    assert ranked.search(docs, items.where("false")).collect() == []
    assert ranked.search(docs, items).count() == 1


def test_few_masks_are_scored():
    """Documents of masks whose maximum is too low are never scored."""
    draw = np.random.default_rng(1)
    holds = draw.random((4_000, 12)) < np.linspace(.01, .6, 12)
    sizes = holds.sum(1)
    at = np.concatenate([np.flatnonzero(r) for r in holds])
    parts = draw.integers(500_000, 600_000, len(at))
    block = ranked.Block([((False, i), i) for i in range(4_000)], sizes, at, parts, 12)
    weights = np.linspace(5_000, 100, 12).astype(np.int64)
    scored = []
    plain = block.scores
    block.scores = lambda docs, w: scored.append(len(docs)) or plain(docs, w)
    best = ranked.evaluate(block, (np.arange(12), weights), 12, [], 10)
    every = plain(np.arange(4_000), weights)
    assert [(-b[0], b[2]) for b in best] == sorted(((int(s), i) for i, s in enumerate(every)), key=lambda r: (-r[0], r[1]))[:10]
    assert sum(scored) < 400
