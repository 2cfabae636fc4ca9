"""Packing: an exact round trip of the tokens, gapless sequences, and the plain best-fit count."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tablewright.llm import packing
from tablewright.llm.tokens import ids_of, vocabulary_path

ROWS = [(1, None), (2, ""), (3, "<|endoftext|> is text"), (None, "a b"), (None, "a b"), (7, "word " * 6000), (8, "é̀ 😀​ ½Ⅷ\x00  \n\n x"),
        (9, "a" * 30_000), (10, "x y z"), (10, "x y z")]


def tokenizer():
    return Tokenizer.from_file(vocabulary_path())


def whole(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")


def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS piece", "2 AS length")


@pytest.mark.parametrize("make", [whole, odd])
def test_round_trip(spark, make):
    docs = make(spark).repartition(5)
    rows = packing.pack(docs, with_ids=True).collect()
    slow = tokenizer()
    want = defaultdict(list)
    for r in docs.collect():
        want[r["doc_id"]].append(tuple(slow.encode(r["text"] or "", add_special_tokens=False).ids + [2]))
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.array(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 1024
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        assert r["length"] == 1024 or r["piece"] == 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        got[r["doc_id"]].append((r["piece"], r["start"], tuple(r["ids"])))
    for key, texts in want.items():
        cut = []
        for ids in texts:
            start, stop, piece = 0, len(ids) % 1024 or 1024, 0
            while start < len(ids):
                cut.append((piece, start, ids[start:stop]))
                start, stop, piece = stop, stop + 1024, piece + 1
        assert sorted(got[key]) == sorted(cut)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(docs.limit(0)).collect() == []


def best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_rounds_need_no_more_sequences_than_best_fit(seed):
    draw = random.Random(seed)
    capacity = draw.choice([10, 50, 1024])
    lengths = [draw.randint(1, max(1, capacity // draw.choice([1, 2, 5]))) for _ in range(400)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs = packing.match_rounds(counts, capacity)
    taken, used = defaultdict(list), defaultdict(int)
    for r in runs:
        for rank in range(r.first, r.last):
            s = r.sequence + rank - r.first
            taken[s].append((r.offset, r.length))
            used[r.length, rank] += 1
    assert used == {(n, i): 1 for n, c in counts.items() for i in range(c)}
    for places in taken.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(taken) <= best_fit(lengths, capacity) + 1


def test_ids_agree_with_the_other_library():
    slow, path = tokenizer(), vocabulary_path()
    draw = random.Random(1)
    for _ in range(300):
        text = "".join(draw.choice(["a", " ", "\n", "'s", "'LL", "7", "é", "中", "😀", "́", "_", "$", "\x7f", "Ⅷ"]) for _ in range(60))
        assert slow.encode(text, add_special_tokens=False).ids == ids_of(text, path).tolist()
