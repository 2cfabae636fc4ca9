"""Suffix arrays against sorting, and the removal of repeats against all windows in plain Python."""

import hashlib
import random

import numpy as np
import pytest

from tablewright.llm import flat, repeats
from tablewright.llm.suffixes import suffix_array


@pytest.mark.parametrize("letters", [1, 2, 3, 200])
def test_suffix_array(letters):
    draw = random.Random(letters)
    for size in [*range(12), *[draw.randrange(120) for _ in range(300)]]:
        text = bytes(draw.randint(1, letters) for _ in range(size)) + b"\0"
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    for text in (b"ab" * 50, b"abaab" * 30, b"mississippi", b"aab" * 20 + b"aac"):
        assert suffix_array(text + b"\0") == sorted(range(len(text) + 1), key=lambda i: (text + b"\0")[i:])


def brute(rows):
    """Rows as (key, text): what the contract asks for, by a table of all windows."""
    order = lambda k: 2 ** 63 if k is None else k
    least = {}
    data = [(k, (t or "").encode()) for k, t in rows]
    for k, b in data:
        for i in range(len(b) - 49):
            w = b[i:i + 50]
            least[w] = min(least.get(w, 2 ** 64), order(k))
    out = []
    for k, b in data:
        lost = bytearray(len(b))
        for i in range(len(b) - 49):
            if least[b[i:i + 50]] < order(k):
                lost[i:i + 50] = b"\1" * 50
        spans = sum(lost[i] and not (i and lost[i - 1]) for i in range(len(b)))
        kept = bytes(c for c, gone in zip(b, lost) if not gone)
        out.append((k, len(b), sum(lost), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(frame, **options):
    got = sorted(map(tuple, repeats.remove_repeats(frame, **options).collect()), key=str)
    want = brute([(r["doc_id"], r["text"]) for r in frame.collect()])
    assert got == want
    return want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_tables(spark, sf):
    want = check(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").repartition(6))
    assert sum(r[2] for r in want) > 0


def passages(seed):
    draw = random.Random(seed)
    word = lambda n: "".join(draw.choice("abcdé \n") for _ in range(n))
    shared = [word(n) for n in (49, 50, 51, 60, 74, 75, 76, 100, 200, 400)] + ["z" * 90, "xy" * 60, "abc" * 40]
    rows = [(i, "".join(draw.choice([word(draw.randrange(80)), draw.choice(shared)[draw.randrange(12):]]) for _ in range(8)))
            for i in draw.sample(range(-50, 400), 60)]
    return rows + [(None, shared[9]), (None, shared[9] + "tail"), (500, None), (501, ""), (502, "short"), (500, shared[8]), (500, shared[8]),
                   (900, "q" * 5000), (901, "q" * 4000 + shared[9])]


@pytest.mark.parametrize("seed", range(3))
def test_planted_passages(spark, seed):
    schema = "doc_id long, text string"
    frame = spark.createDataFrame(passages(seed), schema).repartition(4).selectExpr("*", "1 AS bucket", "2 AS kind")
    check(frame)
    check(frame, hot_contexts=2)  # windows of most anchors are dealt over tasks by their content


def test_windows_of_one_anchor(spark):
    rows = [(1, 2, b"abcdefghijklmnopqrstuvwxyz1"), (2, 1, b"abcdefghijklmnopqrstuvwxyz"), (3, 1, b"bcdefghijklmnopqrstuvwxyz1")]
    assert repeats.repeated_windows(rows) == [0, 1, 1]
    assert repeats.repeated_windows([(7, 1, b"a" * 26)]) == [0]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(empty).collect() == []


def test_only_anchors_and_contexts_are_hashed_in_full(monkeypatch):
    """Each window of each text is in one run; the costly mixing is for the runs, not for every byte."""
    draw, mixed, mix = random.Random(5), [], flat.mix
    for module in (flat, repeats):
        monkeypatch.setattr(module, "mix", lambda h: mixed.append(len(h)) or mix(h))
    sizes = [0, 49, 0, 50, 51, 3, 1, 48, 30_000, 0, *[draw.randrange(160) for _ in range(300)], 0, 49]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    data = np.array([draw.choice(b"abcdefgh ") for _ in range(edges[-1])], np.uint8)
    text, first, count, anchor, _, _ = repeats._runs(data, edges)
    assert np.bincount(text, count, len(sizes)).tolist() == [max(n - 49, 0) for n in sizes]
    assert (edges[text] <= first).all() and (first + count + 49 <= edges[text + 1]).all()
    assert (first + count - 1 <= anchor).all() and (anchor + 25 <= first + 50).all()
    assert sum(mixed) < len(data)


def test_order_with_ties():
    draw = np.random.default_rng(2)
    for n in (0, 1, 2, 500):
        key, a, b = draw.integers(0, 60, n).astype(np.uint64), draw.integers(0, 3, n), draw.integers(-5, 5, n)
        order, want = repeats._ordered(key, a, b), np.lexsort((b, a, key))
        assert sorted(order.tolist()) == list(range(n)) and all((x[order] == x[want]).all() for x in (key, a, b))


def test_suffix_arrays_are_spread_over_tasks(spark, monkeypatch):
    """The buckets of contexts keep tasks of their own, however few bytes they are."""
    parts, written = {}, repeats.written
    monkeypatch.setattr(repeats, "ANCHOR_BYTES", 20_000)
    monkeypatch.setattr(repeats, "written", lambda df, name: parts.update({name: df.rdd.getNumPartitions()}) or written(df, name))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    size = sum(len((r["text"] or "").encode()) for r in docs.collect())
    check(docs.repartition(4))
    assert parts["compared"] >= size // 20_000


def test_only_windows_that_another_document_may_have_reach_a_suffix_array(monkeypatch):
    """Contexts of one anchor mostly differ in most of their windows, and a suffix array costs most of a byte's work."""
    draw = random.Random(9)
    span, read, want = repeats.SPAN, [], {}
    word = lambda n: bytes(draw.randrange(2, 250) for _ in range(n))
    contexts = []  # anchor, document, symbols
    for anchor in (5, 5, 5, 8, 8, 9):
        passage = word(60)
        contexts += [(anchor, doc, word(draw.randrange(9)) + passage[a:b] + word(draw.randrange(9))) for doc, a, b in ((3, 0, 40), (4, 5, 45), (4, 9, 36), (7, 30, 58))]
    contexts += [(8, 11, word(span)), (10, 12, contexts[0][2][:span])]
    contexts = [(a, d, s[:2 * span - 1]) for a, d, s in contexts]
    for a, d, s in contexts:
        for w in range(len(s) - span + 1):
            want.setdefault((a, s[w:w + span]), []).append(d)
    masks = {i: sum(1 << w for w in range(len(s) - span + 1) if min(want[a, s[w:w + span]]) < d) for i, (a, d, s) in enumerate(contexts)}
    array = repeats.suffix_array
    monkeypatch.setattr(repeats, "suffix_array", lambda text: read.append(len(text)) or array(text))
    numbers = np.arange(len(contexts), dtype=np.uint64)
    blob = repeats.blobs.join([
        np.array([a for a, _, _ in contexts], "<u8"), np.zeros(len(contexts), "<u4"), np.array([d for _, d, _ in contexts], "<i8"), repeats.blobs.narrow(numbers, 6),
        np.zeros(len(contexts), "u1"), np.array([len(s) - span + 1 for _, _, s in contexts], "u1"), np.array([len(s) for _, _, s in contexts], "<u4"),
        np.frombuffer(b"".join(s for _, _, s in contexts), "u1")])
    out = repeats._compare(4)(repeats.pa.table({"bucket": [1], "kind": [0], "data": [blob]}))
    got = {}
    for data in out.column("data").to_pylist():
        _, context, mask = repeats.blobs.split(data, repeats._VERDICT)
        got.update(zip(repeats.blobs.wide(context, 6).tolist(), mask.tolist()))
    assert got == {i: m for i, m in masks.items() if m} and len(got) > 6
    shared = [(a, s[w:w + span]) for a, _, s in contexts for w in range(len(s) - span + 1) if len(set(want[a, s[w:w + span]])) > 1]
    assert sum(read) < sum(len(s) for _, _, s in contexts) * 0.8 and len(shared) > 20
    assert repeats._compare(4)(repeats.pa.table({"bucket": [1], "kind": [0], "data": [repeats.blobs.join([np.zeros(0)] * 8)]})).num_rows == 0
