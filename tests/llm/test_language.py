"""Language identification: held-out accuracy, gradients, windows and odd rows."""

import zlib

import numpy as np
import pytest

from tablewright.llm import language

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    net = language.learn(docs)
    return docs, net, language.identify(docs).collect()


def test_held_out_accuracy(found):
    docs, _, rows = found
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_labels_of_the_held_out_are_never_used(spark, found):
    docs, net, _ = found
    hidden = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 'xx' ELSE lang END AS lang")
    again = language.learn(hidden)
    assert again.languages == net.languages
    assert all((a == b).all() for a, b in zip(again.parameters(), net.parameters()))


def test_every_window_of_the_text_counts(found, spark):
    """The score is the mean over windows of 128 bytes, computed one by one."""
    _, net, rows = found
    for r in sorted(rows, key=lambda r: -len(r["text"]))[:3] + rows[:20]:
        data = r["text"].encode()
        cut = [data[i:i + 128].ljust(128, b"\0") for i in range(0, len(data), 128)]
        mean = np.mean([language.probabilities(net, np.frombuffer(c, np.uint8).reshape(1, -1))[0] for c in cut], axis=0)
        assert net.languages[mean.argmax()] == r["lang_pred"]
        assert r["score"] == pytest.approx(mean.max(), abs=1e-4)


def test_odd_rows(spark, found):
    _, net, _ = found
    rows = [(1, None, "a"), (2, "", "a"), (3, "12 %% \n", "a"), (None, "the words of that", "a"), (5, "é", "a"), (6, "the " * 50_000, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = {r["doc_id"]: r for r in language.predict(frame, net).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert got[None]["lang_pred"] == got[6]["lang_pred"] == "en"
    assert got[5]["lang_pred"] in net.languages
    assert language.predict(frame.limit(0), net).collect() == []
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in language.identify(unlabelled).collect()] == ["und"]
    assert language.identify(unlabelled.limit(0)).collect() == []


def test_training_separates_two_alphabets():
    draw = np.random.default_rng(1)
    x = np.concatenate([draw.integers(97, 105, (80, 128)), draw.integers(105, 113, (80, 128))]).astype(np.uint8)
    y = np.repeat([0, 1], 80)
    net = language.train(x, y, ["a", "b"], epochs=6)
    assert (language.probabilities(net, x).argmax(1) == y).mean() > 0.98
