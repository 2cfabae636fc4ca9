"""Token ids and pieces against the ``tokenizers`` library as it reads the vocabulary file, with no setting changed."""

import random
import re
import zlib

import numpy as np
from tokenizers import Tokenizer

from tablewright.llm import packing
from tablewright.llm.tokens import ids_of, vocabulary_path

ADDED = "<|endoftext|>"


def reference(text):
    return Tokenizer.from_file(vocabulary_path()).encode(text, add_special_tokens=False).ids


def test_added_token_has_its_own_id(spark):
    draw, path = random.Random(7), vocabulary_path()
    assert ids_of(f"{ADDED} is text", path).tolist() == [50256, 318, 2420]
    slow = Tokenizer.from_file(path)
    for _ in range(500):
        text = "".join(draw.choice([ADDED, ADDED, "<|endoftext", "|>", " ", "  ", "\n", "a", "word", "'s", "7", "é", "<"]) for _ in range(20))
        assert ids_of(text, path).tolist() == slow.encode(text, add_special_tokens=False).ids
    texts = {1: f"{ADDED} is text", 2: f"a {ADDED}  \n{ADDED}{ADDED} b", 3: "plain", 4: f"x {ADDED} " * 900}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = sorted(packing.pack(docs).collect(), key=lambda r: (r["doc_id"], r["piece"]))
    for key, text in texts.items():
        ids = np.array([*reference(text), 2], "<u4")
        pieces = [r for r in rows if r["doc_id"] == key]
        assert sum(r["length"] for r in pieces) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) for r in pieces)


def test_long_runs_of_white_space(spark):
    n, path = 1_100_000, vocabulary_path()
    runs = [" " * n, "\n" * n, " \n" * (n // 2), "　" * n, "\t" * n + " "]
    texts = [f"a b{runs[0]}word", f"{runs[1]}word", f"x.{runs[2]}!{runs[0]}", runs[3] + "é", f"7{runs[4]}{ADDED} z", f"{runs[4]}'s", runs[1]]
    for text in [*texts, *(f"a{' ' * k}\n{end}" for k in (99_998, 99_999, 100_000) for end in ("", "b", ADDED))]:
        assert np.array_equal(ids_of(text, path), reference(text))
    rows = packing.pack(spark.createDataFrame([(1, texts[0]), (2, "b")], "doc_id long, text string")).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == len(reference(texts[0])) + 1
    assert [r["length"] for r in rows if r["doc_id"] == 2] == [2]


def test_white_space_is_the_same_to_both_sides():
    """Every single white-space character in a long run, as the tokenizer's pattern sees it."""
    from tablewright.llm import tokens
    space = {c for c in map(chr, range(0x110000)) if c.isspace()} - set("\x1c\x1d\x1e\x1f")
    assert space == {c for c in map(chr, range(0x110000)) if re.match(tokens._SPACE_RUN.pattern.split("{")[0], c)}
    slow = Tokenizer.from_file(vocabulary_path())
    for c in sorted(space | set("\x1c\x1d\x1e\x1f᠎​")):
        text = f"a{c}{c}{c}b"
        assert ids_of(text, vocabulary_path()).tolist() == slow.encode(text, add_special_tokens=False).ids
