"""The n-gram join against all pairs in plain Python."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import ngram_join
from tablewright.llm.graph import components

SPACE = r"[^\x20\x09-\x0D]+"


def shingles(text, width=4):
    words = re.findall(SPACE, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute(rows):
    sets = {k: shingles(t) for k, t in rows}
    by, parent = {}, {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for k, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(k)
    seen = set()
    for ks in by.values():
        for i, a in enumerate(ks):
            for b in ks[:i]:
                if (a, b) in seen or find(a) == find(b):
                    continue
                seen.add((a, b))
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


def check(frame, **options):
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(frame, **options).collect()}
    want = brute(rows)
    assert got == want
    return want


def test_counts_of_a_set_do_not_grow_with_the_table(spark, monkeypatch):
    """Five times the rows have about five times the (set, fragment) counts, and texts go to the workers in small batches."""
    assert ngram_join.fragment_count(3_000_000) == ngram_join.fragment_count(15_000_000)
    assert ngram_join.fragment_count(400_000_000) == 1_000
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, write = spark.conf.get(name), ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, kind: seen.append((kind, int(spark.conf.get(name)))) or write(df, kind))
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    assert {r["component_id"] for r in ngram_join.link_components(docs).collect()} == {1}
    assert {rows for kind, rows in seen if kind in ("fingerprints", "survivors", "sets")} == {ngram_join.TEXTS_PER_BATCH}
    assert spark.conf.get(name) == before


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_tables(spark, sf):
    want = check(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))
    assert len({c for _, c in want.values()}) < len(want)


def test_families_of_near_copies(spark):
    """Families whose members lie on both sides of the threshold, passages that many share, short and odd texts."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    passage, rows = [word() for _ in range(40)], []
    for family in range(6):
        base = [word() for _ in range(draw.choice([12, 60, 300]))]
        for _ in range(60):
            copy = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 25))):
                copy[draw.randrange(len(copy))] = word()
            if draw.random() < 0.3:
                copy = passage + copy
            rows.append(" ".join(copy))
    rows += [None, "", " \n", "one", "One", "one two", "one  two\tthree", "a b c d", "A B C D", "a b c d e", "x " * 5000, "x " * 4000]
    draw.shuffle(rows)
    frame = spark.createDataFrame([(i + 10, t, "x", "y") for i, t in enumerate(rows)], "doc_id long, text string, n string, v string")
    check(frame.repartition(5), block=16)
    check(frame)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d e f g h"), (3, "a b c d e f g h"), (3, "a b c d e f g h"), (5, "A b c d e f g h"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.link_components(frame).collect()), key=str)
    assert got == sorted([(None, 5, None), (3, 5, 3), (3, 5, 3), (5, 5, 3), (None, 0, None)], key=str)
    assert ngram_join.link_components(frame.limit(0)).collect() == []
    kept = ngram_join.keep_one(frame.where("doc_id IS NULL OR doc_id = 5"))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 5]


def test_threshold_is_exact(spark):
    """17 of 20 shared is a link, 16 of 19 is none."""
    base = [f"w{i}" for i in range(30)]
    for cut, linked in ((17, True), (16, False)):
        a, b = base[:cut + 3], base[:cut + 3]
        total = 20 if linked else 19
        b = b + [f"z{i}" for i in range(total - len(shingles(" ".join(a))))]
        frame = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
        components_ = {r["component_id"] for r in ngram_join.link_components(frame, threshold=Fraction(85, 100)).collect()}
        assert (len(components_) == 1) == linked


def test_components(spark):
    draw = random.Random(3)
    links = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)]
    label = {v: v for pair in links for v in pair}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["vertex"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: m for v, m in label.items() if any(a != b and v in (a, b) for a, b in links)}


def test_global_order_of_packed_sets(spark, monkeypatch):
    """Shared n-grams by (document count, hash), sets with too few left out, and fragments of about as many n-grams."""
    monkeypatch.setattr(ngram_join, "ENTRIES_PER_FRAGMENT", 500)
    draw = np.random.default_rng(5)
    pool = draw.integers(-2 ** 63, 2 ** 63 - 1, 400)
    sets = {int(v): sorted({int(x) for x in draw.choice(pool, n)} | {int(x) for x in draw.integers(-2 ** 63, 2 ** 63 - 1, own)})
            for v, n, own in zip(draw.integers(-2 ** 63, 2 ** 63 - 1, 60), draw.integers(20, 90, 60), [0, 1, 30] * 20)}
    rows = spark.createDataFrame([(v, len(g), g) for v, g in sets.items()], "v long, n long, grams array<bigint>").repartition(5)
    df = Counter(x for g in sets.values() for x in g)
    limit = Fraction(4, 5)
    want = {}
    for v, g in sets.items():
        least, shared = math.ceil(len(g) * limit), sorted((df[x], x) for x in g if df[x] > 1)
        if len(shared) >= least:
            want[v] = (len(g), shared, len(shared) - least + 1)
    got = {r["v"]: r for r in ngram_join._ordered(rows, limit).collect()}
    assert 20 < len(want) < 60 and {v: (r["n"], [(g["df"], g["h"]) for g in r["grams"]], r["prefix"]) for v, r in got.items()} == want
    fragment = {(g["df"], g["h"]): g["fragment"] for r in got.values() for g in r["grams"]}
    assert [fragment[k] for k in sorted(fragment)] == sorted(fragment.values()) and set(fragment.values()) == {0, 1, 2, 3}
    assert ngram_join._cuts({}) == [] and ngram_join._ordered(rows.where("false"), limit).collect() == []


def test_n_grams_are_ordered_without_a_row_for_each(spark):
    """The steps on single n-grams cost most of the join; they are packed by range of their hash now."""
    batch = pa.RecordBatch.from_pylist([{"v": 3, "n": 2, "grams": [5, -7]}, {"v": 4, "n": 1, "grams": [5]}])
    packed = pa.Table.from_batches(list(ngram_join._deal(1)([batch])))
    assert packed.num_rows == 1
    counted = ngram_join._count_sets(2)(packed).to_pylist()
    assert [(r["place"], r["rows"]) for r in counted if r["place"]] == [(2, 1)]
    assert [(np.frombuffer(r["owners"], "i8").tolist(), np.frombuffer(r["df"], "i8").tolist()) for r in counted if r["bucket"] is not None] == [([3, 4], [2, 2])]
