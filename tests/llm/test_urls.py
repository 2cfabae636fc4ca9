"""URL rules and the Bloom cascade against plain Python."""

import random

import numpy as np
import pytest

from tablewright.llm import urls

ROWS = [None, "", "no scheme/x", "http://", "HTTP://A.Example.NET/en/x?y#z", "http://example.net/en", "http://net/", "http://net", "x://y.net?q/",
        "http://examplenet/", "a://b://c.org/fr/é", "http://x.ORG/fr/\nnext", "http://x.org/frx", "http://xexample.com/de/", "http://example.com/de/",
        "http://É.net/" + "p/" * 30_000, "//example.net/", "http://u.net/#f", "http://u.net/#f", ":// .net/ "]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path = tail[:min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


@pytest.mark.parametrize("bound", [urls.BROADCAST_BYTES, 0])
def test_whole_table_and_odd_urls(spark, bound):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(10_000 + i, u) for i, u in enumerate(ROWS)] + [(None, "http://a.net/")], "page_id long, url string")
    both = pages.union(odd).selectExpr("*", "'x' AS rule", "1 AS shard", "2 AS h")
    rows = urls.judge(both, broadcast_bytes=bound, keys_per_shard=50).collect()
    assert len(rows) == both.count()
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(r["url"])
    assert urls.judge(both.limit(0)).collect() == []


@pytest.mark.parametrize("share", [0.0, 0.01, 0.5, 1.0])
def test_cascade_is_exact(share):
    draw = np.random.default_rng(4)
    h, g = draw.integers(0, 1 << 63, (2, 20_000), dtype=np.uint64)
    listed = draw.random(20_000) < share
    levels = urls.build_levels(h, g, listed)
    assert (urls.is_listed(levels, h, g) == listed).all()
    if 0 < share < 1:
        assert len(levels) > 1  # false positives had to be listed too


def test_keys_that_hash_alike_are_refused():
    same = np.array([5, 5], np.uint64)
    with pytest.raises(ValueError):
        urls.build_levels(same, same, np.array([True, False]))


def test_order_of_keys_does_not_matter():
    draw = random.Random(1)
    h = np.array([draw.getrandbits(63) for _ in range(3000)], np.uint64)
    listed = h % np.uint64(3) == 0
    order = np.array(draw.sample(range(3000), 3000))
    a, b = urls.build_levels(h, h, listed), urls.build_levels(h[order], h[order], listed[order])
    assert all((x == y).all() for x, y in zip(a, b))


@pytest.mark.parametrize("bound", [urls.BROADCAST_BYTES, 0])
def test_many_rules(spark, bound):
    draw = random.Random(8)
    labels = ["a", "b", "c", "é", "net", "org"]
    rules = {}
    while len(rules) < 100_000:
        host = ".".join(draw.choice(labels) + str(draw.randrange(30)) for _ in range(draw.randrange(1, 5)))
        path = "/" + "".join(draw.choice("xyzé/") for _ in range(draw.choice([0, 1, 2, 5])))
        rules[host, path] = draw.choice(["block", "allow"])
    names = list(rules)
    pages = []
    for i in range(3000):
        host, path = draw.choice(names)
        pages.append((i, "http://" + draw.choice(["", "w.", "w", "a1.b2."]) + host + path + draw.choice(["", "x", "/tail?q", "\u00e9#z"])))
    table = spark.createDataFrame([(v, h, p) for (h, p), v in rules.items()], "verdict string, host string, path string")
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules=table, broadcast_bytes=bound).collect()}
    assert len(got) == len(pages)
    for key, url in pages:
        host, path, _, _ = plain(url)
        parts = host.split(".")
        above = [".".join(parts[i:]) for i in range(len(parts))]
        fits = [(len(a) + n, len(a), a, path[:n]) for a in above for n in range(len(path) + 1) if (a, path[:n]) in rules]
        best = max(fits, default=None)
        assert (got[key]["rule"], got[key]["verdict"]) == ((best[2] + best[3], rules[best[2:]]) if best else (None, "allow"))


def test_no_rules_and_one_name_with_both_verdicts(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert {(r["rule"], r["verdict"]) for r in urls.judge(pages, rules=[]).collect()} == {(None, "allow")}
    both = [urls.Rule("allow", "net", "/"), urls.Rule("block", "net", "/")]
    assert {(r["page_id"], r["rule"], r["verdict"]) for r in urls.judge(pages, rules=both).collect()} == {(1, "net/", "block"), (2, None, "allow")}
