"""Periodic runs against plain Python: every period of every stretch."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tablewright.llm import periods
from tablewright.llm.queries import QUERIES


def brute(words, least=6, times=4):
    out, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            stretch = words[i:i + size]
            smallest = not any(stretch[d:] == stretch[:-d] for d in range(1, q))
            if j > i and size >= max(least, times * q) and smallest:
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(draw, letters):
    words = []
    while len(words) < draw.randrange(1, 120):
        unit = [draw.randrange(letters) for _ in range(draw.randrange(1, 10))]
        words += unit * draw.choice([1, 1, 2, 3, 4, 5, 7])
    return words


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_all_runs(letters):
    for seed in range(400):
        words = some_words(random.Random(f"{letters} {seed}"), letters)
        assert periods.find_runs(np.array(words)) == brute(words), words


def test_edges():
    find = lambda text: periods.find_runs(periods.numbered(text.encode().split()))
    assert find("") == find("a a a a a") == []
    assert find("a a a a a a") == [(0, 6, 1)]
    assert find("a b a b a b a") == [] and find("a b a b a b a b a") == [(0, 9, 2)]
    assert find("x a a a a a a y " * 4) == [(0, 32, 8), *[(8 * i + 1, 6, 1) for i in range(4)]]
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 600:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert find(" ".join(fibonacci[-1])) == []  # holds cubes, but nothing four times


def contract(key, text):
    words = (text or "").encode().split()
    n = len(words)
    if key is not None and n:
        h = zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, z, q in runs for i in range(s + q, s + z)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{z},{q}\n" for s, z, q in runs)
    return (key, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def odd_rows():
    draw = random.Random(12)
    rows = [(i, " ".join("abcdé"[w % 5] * (1 + w // 5) for w in some_words(draw, 7))) for i in range(300)]
    return rows + [(None, "a a a a a a"), (None, "a a a a a a"), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (3, "   "),
                   (4, "word " * 30_000), (5, ("x " * 40 + "y ") * 300), (6, "z\x0bz\x0cz\rz\nz\tz z")]


def query_rows(spark, folder):
    return sorted(map(tuple, QUERIES["op12_periodic_runs"](spark, folder).collect()), key=str)


def test_query_on_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    long = {4, 5}
    want = sorted((contract(*r) for r in odd_rows() if r[0] not in long or len(r[1] or "") < 5_000), key=str)
    got = query_rows(spark, tmp_path)
    assert [r for r in got if r in set(want)] == want and len(got) == len(odd_rows())
    assert any(r[1] for r in want)


def test_long_texts():
    assert periods.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    unit = [1] * 40 + [2]
    words = np.array(unit * 5_000)
    runs = periods.find_runs(words)
    assert (0, len(words), 41) in runs and len(runs) == 5_001


def test_query_on_the_smallest_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in rows if len((r["text"] or "").split()) <= 400]
    got = query_rows(spark, folder)
    assert len(got) == len(rows)
    want = {contract(*r) for r in short}
    assert want <= set(got) and any(r[1] for r in want)


def test_scan_keeps_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([("k", "u u u u u u v", 3, 4)], "name string, text string, runs int, collapsed int")
    assert [tuple(r) for r in periods.scan(rows).collect()] == [("k", "u u u u u u v", [(0, 6, 1)], "u v")]
    assert periods.scan(rows.where("false")).collect() == []
