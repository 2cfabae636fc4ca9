"""The near-copy stage against all pairs in plain Python, at five words and a similarity of 0.8."""

import random
from fractions import Fraction

from test_ngram_join import shingles

import corpus_pipeline


def heads(rows, width, threshold):
    sets, parent = {k: shingles(t, width) for k, t in rows}, {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, s in sets.items():
        for b, t in sets.items():
            if a < b and s and t and Fraction(len(s & t), len(s | t)) >= threshold:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {find(k) for k in sets}


def test_pairs_between_the_two_rules(spark):
    """Copies without their last words, and short texts with one word changed, on both sides of 0.8."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    texts = []
    for cut in (120, 150, 165, 180, 195, 200, 210, 260):
        base = [word() for _ in range(1000)]
        texts += [base, base[:-cut]]
    for n in (44, 47, 48, 49, 50, 51, 52, 53, 60):
        base = [word() for _ in range(n)]
        texts += [base, [*base[:n // 2], word(), *base[n // 2 + 1:]]]
    rows = [(i + 1, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "one two"), (903, "one two")]
    want = heads(rows, 5, Fraction(4, 5))
    assert want < heads(rows, 4, Fraction(85, 100))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == want
