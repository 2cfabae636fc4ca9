"""The pipeline's stages, each against a plain version on its own input."""

import math
from collections import Counter, defaultdict

from test_native import SPACE, waterfill
from test_ngram_join import brute

import corpus_pipeline
from tablewright.llm.tokens import ids_of, vocabulary_path
from tablewright.session import written

FOLDER = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame([(90_001, None, None, None, None), (90_002, "12 34 %%", "en", "s", 8), (90_003, "the words of that", None, "s", 17)], docs.schema)
    docs, seen = written(docs.union(extra), "start"), []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, FOLDER), name)
        seen.append((docs.collect(), after.collect()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        docs = after
    (start, language), (_, exact), (_, near), (_, mixed), (_, packed) = seen

    # Language: wordless texts go, all others stay, a missing language is filled in.
    assert {r["doc_id"] for r in start} - {r["doc_id"] for r in language} == {90_001, 90_002}
    assert [r["lang"] for r in language if r["doc_id"] == 90_003] == ["en"]

    bare = lambda r: "".join(c for c in r["text"] if c not in SPACE)
    best = {}
    for r in sorted(language, key=lambda r: (-len(r["text"]), r["doc_id"])):
        best.setdefault(bare(r), r["doc_id"])
    assert {r["doc_id"] for r in exact} == set(best.values()) and len(exact) == len(best)

    heads = {c for _, c in brute([(r["doc_id"], r["text"]) for r in exact]).values()}
    assert {r["doc_id"] for r in near} == heads and len(near) == len(heads)

    sizes = Counter()
    for r in near:
        sizes[r["source"]] += len(r["text"].split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, waterfill([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    copies, text = Counter(r["doc_id"] for r in mixed), {r["doc_id"]: r for r in near}
    for key, r in text.items():
        rate = target[r["source"]] / sizes[r["source"]]
        assert math.floor(rate - 1e-9) <= copies[key] <= math.ceil(rate)

    lengths, places = defaultdict(int), defaultdict(list)
    for r in packed:
        lengths[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for key, n in copies.items():
        assert lengths[key] == n * (len(ids_of(text[key]["text"], vocabulary_path())) + 1)
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.count() > 0
