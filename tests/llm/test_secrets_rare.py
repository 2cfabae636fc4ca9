"""The field learns from matches that the sample of documents misses."""

import hashlib
import random

from tablewright.llm import secrets


def test_rare_matches_outside_the_sample_are_learned(spark):
    draw = random.Random(4)
    prose = lambda: " ".join("".join(draw.choice("abcdehinorst") for _ in range(draw.randint(2, 8))) for _ in range(12))
    share = lambda i: int(hashlib.md5(f"secrets:{i}".encode()).hexdigest()[:8], 16) / 2 ** 32
    rare = [i for i in range(400) if share(i) > 0.5][:3]
    rows = [(i, f"{prose()} token = \"{draw.getrandbits(96):024x}\" {prose()}" if i in rare else prose()) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    picked = {i for i in range(400) if share(i) < 0.1}
    assert picked and not picked & set(rare)
    assert secrets.learn(docs, rows=40) is not None
    assert secrets.learn(docs.where(~docs["doc_id"].isin(rare)), rows=40) is None
