"""License scan, quality rules, exact duplicates and mixing against plain Python, on whole tables and planted rows."""

import hashlib
import math
import re
from collections import Counter

import pytest

from tablewright.llm import exact, licenses, mixing, quality

FOLDER = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, copies string"
ROWS = [
    (1, None, None, None, None, "a", "b", "c"),
    (2, "", "en", "s", 0, "a", "b", "c"),
    (None, "MIT  License, mit license mit license", "en", "s", 0, None, None, None),
    (None, "MIT  License, mit license mit license", "en", "s", 0, None, None, None),
    (4, "the General-Public license\nand Apache\tlicense; xapache license", "fr", "t", 3, "a", "b", "c"),
    (5, "a b c " * 3000 + "end", "fr", "t", 3, "a", "b", "c"),
    (6, "one\n\n one\none\ntwo # $ three", "fr", "u", 3, "a", "b", "c"),
    (7, " \t\n\x0b", "de", "u", 3, "a", "b", "c"),
    (8, "x MIT LİCENSE ÄÖ license é mit", "de", "u", 3, "a", "b", "c"),
    (9, "intro text. Licensed under CC BY-NC 4.0. outro", "de", "v", 3, "a", "b", "c"),
]


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def planted(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def license_row(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        sought = phrase.split()
        for i in range(len(words) - len(sought) + 1):
            if words[i:i + len(sought)] == sought:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), words


@pytest.mark.parametrize("make", [documents, planted])
def test_licenses(spark, make):
    docs = make(spark)
    ordered = {t.label: t for t in licenses.order_templates(docs.withColumn("w", licenses.words_of(docs["text"])), "w")}
    rows = licenses.scan(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        *base, words = license_row(r["text"])
        assert [r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]] == base
        want = set()
        for t in ordered.values():
            for at in range(0, len(words), t.length):
                shared = len(set(words[at:at + 2 * t.length]) & set(t.tokens))
                if shared >= t.need:
                    want.add((t.label, at, min(len(words), at + 2 * t.length), shared / len(t.tokens)))
        assert {tuple(b) for b in r["blocks"]} == want
        assert r["labels"] == ",".join(sorted({w[0] for w in want} | set(filter(None, base[4].split(",")))))
        assert r["score"] == (1.0 if base[4] else max((w[3] for w in want), default=0.0))


def quality_row(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    counts = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if counts[w] > 1:
            covered |= {i, i + 1, i + 2}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


@pytest.mark.parametrize("make", [documents, planted])
def test_quality_counts(spark, make):
    docs = make(spark)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = quality.judge(docs, labels).drop("text").join(
        docs.select("doc_id", "text").distinct(), "doc_id", "left").collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is None:
            continue
        want = quality_row(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and not r["failed_rules"])


def tail(n, k, p):
    return sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial_tail(spark):
    rows = spark.createDataFrame([(n, k, 0.02) for n in (1, 40, 900) for k in (0, 1, 5, 17)], "n long, k long, p double")
    for r in rows.withColumn("t", quality.binomial_tail("n", "k", "p")).collect():
        want = 1.0 if r["k"] >= r["n"] * r["p"] else tail(r["n"], r["k"], r["p"])
        assert r["t"] == pytest.approx(want, rel=1e-9)


def test_cutoffs_limit_false_rejections(spark):
    """Good and bad rows separate at 0.5; the chosen cutoff rejects the bad and few of the good."""
    rows = [("en", i % 4 != 0, 0.1 if i % 4 else 0.9, 0.0, 0.0, 1.0) for i in range(8000)]
    names = ["symbols_per_word", "repeated_lines", "repeated_words", "word_length"]
    frame = spark.createDataFrame(rows, "stratum string, good boolean, " + ", ".join(f"{n} double" for n in names))
    chosen = quality.choose_cutoffs(frame).collect()
    assert [(r["stratum"], r["cutoffs"]) for r in chosen] == [("en", {"symbols_per_word": 0.7})]
    few = quality.choose_cutoffs(frame.limit(40)).collect()
    assert few == []  # too few labels to guarantee anything
    assert quality.choose_cutoffs(frame.limit(0)).collect() == []


@pytest.mark.parametrize("make", [documents, planted])
def test_exact(spark, make):
    rows = exact.mark_copies(make(spark), capacity=16).collect()
    groups = {}
    for r in rows:
        bare = "".join(c for c in r["text"] or "" if c not in SPACE)
        assert r["text_sha256"] == hashlib.sha256(bare.encode()).hexdigest()
        groups.setdefault(bare, []).append(r)
    for group in groups.values():
        best = min(group, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        assert {r["keep_id"] for r in group} == {best["doc_id"]}
        assert [r["doc_id"] for r in group if r["kept"]] == [best["doc_id"]]
        assert {r["group_size"] for r in group} == {len(group)}
    left = exact.drop_copies(make(spark), capacity=16).collect()
    plain = lambda r: (r["doc_id"], r["text"])
    assert Counter(map(plain, left)) == Counter(map(plain, (r for r in rows if r["kept"])))
    assert exact.drop_copies(make(spark).limit(0)).collect() == []


def test_directory_doubles_until_buckets_fit(spark):
    pages = spark.range(4000).selectExpr("xxhash64(id) AS __h").union(spark.range(900).selectExpr("1L AS __h"))
    cells = {r["cell"]: r for r in exact.directory(pages, 6, 300).collect()}
    sizes = Counter()
    for r in pages.collect():
        sizes[cells[(r["__h"] % 2 ** 64) >> 58]["bucket"]] += 1
    deepest = {r["bucket"] for r in cells.values() if r["depth"] == 6}
    assert all(n <= 300 or b in deepest for b, n in sizes.items())
    assert len(sizes) > 8


def waterfill(sizes, weights):
    """Shares by weight, stopped at three times the size, the excess shared again until none is above."""
    total, stopped = sum(sizes), set()
    while True:
        rest = total - sum(3 * sizes[i] for i in stopped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in stopped)
        target = [3 * s if i in stopped else rest * weights[i] / w for i, s in enumerate(sizes)]
        above = {i for i in range(len(sizes)) if i not in stopped and target[i] > 3 * sizes[i]}
        if not above:
            return target
        stopped |= above


@pytest.mark.parametrize("make", [documents, planted])
def test_mixing(spark, make):
    rows = mixing.plan_mix(make(spark)).collect()
    sizes = {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = waterfill([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[order.index(r["source"])])
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert math.floor(rate) <= r["copies"] <= math.ceil(rate) <= 3
    again = mixing.plan_mix(make(spark).repartition(7)).collect()
    assert Counter(map(tuple, (r.asDict().values() for r in rows))) == Counter(map(tuple, (r.asDict().values() for r in again)))
    assert mixing.mix(make(spark)).count() == sum(r["copies"] for r in rows)
    assert mixing.mix(make(spark).limit(0)).collect() == []
