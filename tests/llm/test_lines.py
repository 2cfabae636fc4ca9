"""Line dedup against plain Python, and its perfect hash against sets."""

import hashlib
import random

import numpy as np
import pytest

from tablewright.llm import lines

SPACES = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def brute(rows):
    order = lambda k: 2 ** 63 if k is None else k
    holders = {}
    for i, (k, t) in enumerate(rows):
        for key in {key_of(ln) for ln in (t or "").split("\n")}:
            if len(key) >= 10:
                holders.setdefault(key, []).append(order(k))
    out = []
    for k, t in rows:
        all_lines = (t or "").split("\n")
        kept = [ln for ln in all_lines if len(holders.get(key_of(ln), [])) < 2 or min(holders[key_of(ln)]) == order(k)]
        text = "\n".join(kept)
        out.append((k, len(all_lines), len(all_lines) - len(kept), hashlib.sha256(text.encode()).hexdigest(), text))
    return sorted(out, key=str)


def check(frame, **options):
    got = sorted(map(tuple, lines.drop_repeated_lines(frame, with_text=True, **options).collect()), key=str)
    want = brute([(r["doc_id"], r["text"]) for r in frame.collect()])
    assert got == want
    return want


@pytest.mark.parametrize("size", [0, 1, 2, 50, 5_000])
def test_perfect_hash(size):
    draw = np.random.default_rng(size)
    h, g = draw.integers(0, 1 << 63, (2, size), dtype=np.uint64)
    h[: size // 3] = 7  # one half alone does not tell keys apart
    slot = lines.PerfectHash(lines.build_levels(h, g))
    assert len(slot) == size and sorted(slot(h, g).tolist()) == list(range(size))
    levels, data = lines.LineIndex.build(h, g, np.arange(size) % 4 + 1, np.arange(size) - 5)
    index = lines.LineIndex.read(levels, data)
    counts, first = index.lookup(h, g)
    assert counts.tolist() == [i % 4 + 1 for i in range(size)]
    assert all(f == i - 5 for i, f in enumerate(first.tolist()) if i % 4)
    assert not index.lookup(h, g ^ np.uint64(1 << 40))[0].any()  # unknown lines have other fingerprints


def planted(seed):
    draw = random.Random(seed)
    shared = ["Terms of use apply", " terms OF use apply\t", "ééééééééé", "éééééééééé", "ÉÉÉÉÉÉÉÉÉÉ", "1234567890", "123456789", "", "  ",
              "line with\x0bspace", "carriage return\r", "K" * 12, "K" * 12, "x" * 5_000]
    rows = [(i, "\n".join(draw.choice([draw.choice(shared), f"only here {i} {j}"]) for j in range(draw.randrange(1, 12))))
            for i in draw.sample(range(-60, 300), 80)]
    return rows + [(None, "Terms of use apply\nnobody's own line"), (None, "Terms of use apply\nnobody's own line"), (None, None),
                   (400, None), (401, ""), (402, "\n\n"), (403, "twice in one row\ntwice in one row"), (500, "same key and text\nTerms of use apply"),
                   (500, "same key and text\nTerms of use apply"), (500, "same key and text"), (900, "Terms of use apply\n" * 40_000)]


@pytest.mark.parametrize("seed", range(2))
def test_planted_lines(spark, seed):
    frame = spark.createDataFrame(planted(seed), "doc_id long, text string").repartition(4)
    frame = frame.selectExpr("*", "1 AS shard", "2 AS key", "3 AS gone", "4 AS n_lines")
    want = check(frame)
    assert any(r[2] for r in want)
    # Many shards, and probes of each dealt over tasks.
    check(frame, shard_keys=60, probes_per_task=20)


def test_whole_table(spark):
    assert any(r[2] for r in check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(6)))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.drop_repeated_lines(empty).collect() == []
    assert [tuple(r) for r in lines.drop_repeated_lines(spark.createDataFrame([(1, None)], empty.schema)).collect()] == [
        (1, 1, 0, hashlib.sha256(b"").hexdigest())]
