"""Secret scan: fixed patterns against plain expressions, Viterbi and the fit against all tag sequences, planted secrets."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from tablewright.llm import secrets

FOLDER = "/root/testdata/sf0.001"


def plain(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32])


ODD = ["", None, "PassWord : 'short' password='longenough1'", "é api_key=\"abc-def/ghi=\" ſecret=abcdefghij", "AKIAAKIA1234567890 xAKIA12 AKIA" + "A" * 12,
       "0" * 31 + "g" + "f" * 32 + "G" + "a" * 200, "token=token=token=abcdefgh", "secret:\nabcdefgh secret:  x", "\x00passwd\":= a password=........",
       "word " * 20_000 + "token = 0123456789", "apikey='" + "z" * 50_000]


def test_patterns_of_whole_table_and_odd_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "token=abcdefgh")], "doc_id long, text string")
    both = docs.union(odd).selectExpr("*", "1 AS spans", "2 AS key")
    texts = {r["doc_id"]: r["text"] or "" for r in both.collect()}
    rows = secrets.scan(both, None).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [(s["start"], s["kind"], s["stop"]) for s in r["spans"]] == plain(texts[r["doc_id"]])
    assert secrets.scan(both.limit(0), None).collect() == []
    assert secrets.learn(both.limit(0)) is None


def test_words_over_the_border_of_two_texts():
    """A keyword that two neighbours make together takes no letter from one that the second holds."""
    keywords = ["password", "passwd", "secret", "token", "api_key", "apikey"]
    texts = [t for a in keywords for b in keywords for cut in range(len(a)) for t in (a[:cut], f"{b}=abcdefgh")]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    (out,) = secrets._scan(None)(iter([batch]))
    for text, spans in zip(texts, out.column(1).to_pylist()):
        assert [(s["start"], s["kind"], s["stop"]) for s in spans] == plain(text)


def test_registered_digest(spark):
    rows = entry.queries()["op8_secret_scan"](spark, FOLDER).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in rows:
        want = plain(texts[r["doc_id"]])
        listed = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


def random_field(draw, features):
    return secrets.Field(draw.normal(0, 1, (features, 3)), draw.normal(0, 1, (3, 3)))


def score(field, scores, tags):
    total, moves = 0.0, secrets._allowed(field.moves)
    for i, t in enumerate(tags):
        total += scores[i][t] + (moves[tags[i - 1], t] if i else (secrets._NEVER if t == secrets.INSIDE else 0))
    return total


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_finds_the_best_of_all_sequences(seed):
    draw = np.random.default_rng(seed)
    field = random_field(draw, 4)
    lines = np.repeat(np.arange(9), draw.integers(1, 7, 9))
    scores = draw.normal(0, 2, (len(lines), 3)) + [draw.choice([0, 2, 6]), 0, 0]
    tags = secrets.viterbi(field, scores, lines)
    for line in range(9):
        own = scores[lines == line]
        best = max(score(field, own, t) for t in itertools.product(range(3), repeat=len(own)))
        assert score(field, own, tags[lines == line]) == pytest.approx(best)


def test_fit_raises_the_likelihood():
    draw = np.random.default_rng(0)
    features = draw.integers(0, 6, (40, secrets.SEGMENT, 8)) + secrets._BASES[:-1]
    tags = np.where(features[..., 0] == 3, secrets.BEGIN, secrets.OUTSIDE)
    field = secrets.fit(features, tags, np.full(40, secrets.SEGMENT))
    scores = field.weights[features[0]].sum(axis=1)
    assert (secrets.viterbi(field, scores, np.zeros(secrets.SEGMENT)) == tags[0]).mean() > 0.97


def test_field_finds_secrets_that_no_pattern_names(spark):
    """Trained on assignments, it tags like values after another word, and leaves prose alone."""
    draw = random.Random(2)
    code = lambda n: "".join(draw.choice("0123456789abcdefABCDEF") for _ in range(n))
    prose = lambda: " ".join("".join(draw.choice("abcdehinorst") for _ in range(draw.randint(2, 8))) for _ in range(12))
    rows = [(i, f"{prose()} {draw.choice(['token', 'secret', 'password'])} = \"{code(24)}\" {prose()}\n{prose()}") for i in range(150)]
    docs = spark.createDataFrame(rows + [(1000 + i, prose()) for i in range(150)], "doc_id long, text string")
    field = secrets.learn(docs)
    tests = [(i, f"{prose()} credential = \"{code(24)}\" {prose()}") for i in range(20)] + [(100 + i, prose()) for i in range(20)]
    texts = dict(tests)
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(tests, "doc_id long, text string"), field).collect()}
    hits = [texts[i][s["start"]:s["stop"]] for i in range(20) for s in found[i]]
    assert sum(len(h) == 24 for h in hits) >= 15
    assert not any(found[100 + i] for i in range(20))


def test_tokens_know_their_line():
    column = pa.array(["a=b c\nd", "", "e f"])
    from tablewright.llm.flat import chunks
    (_, _, data, edges), = chunks(column)
    tokens = secrets.tokenize(data, edges)
    assert tokens.text.tolist() == [0, 0, 0, 0, 2, 2]
    assert len(set(tokens.line[:3])) == 1 and len(set(tokens.line)) == 3
