"""Ordered target means against a plain loop."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators import models as L
from tablewright.operators import ordered as O


def rows_of(seed, n=400):
    draw = random.Random(seed)
    return [(i, draw.choice(["a"] * 9 + ["b", "c", None]), draw.choice("xyz"), float(draw.randrange(-5, 9)), float(draw.random() < .3)) for i in range(n)]


def brute(rows, strength):
    order = sorted(rows, key=lambda r: (hashlib.md5(f"{O.SEED}:{r[0]}".encode()).hexdigest(), r[0]))
    seen, total, out = {}, [0, 0.0, 0.0], {}
    for r in order:
        codes = []
        for c in (1, 2):
            own = seen.setdefault((c, r[c]), [0, 0.0, 0.0])
            codes += [(own[j] + strength * (total[j] / total[0] if total[0] else 0)) / (own[0] + strength) for j in (1, 2)]
        out[r[0]] = codes
        for s in (total, seen[(1, r[1])], seen[(2, r[2])]):
            s[0], s[1], s[2] = s[0] + 1, s[1] + r[3], s[2] + r[4]
    return out


@pytest.mark.parametrize("small", [1_000_000, 60])  # one window, or ranges with offsets
def test_codes_of_the_rows_before(spark, small):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, "id long, u string, v string, y double, z double").repartition(3)
    got = O.ordered_codes(df, ["u", "v"], ["y", "z"], ["id"], strength=2.0, small=small)
    assert got.columns == ["id", "u", "v", "y", "z", "u__y", "u__z", "v__y", "v__z"]
    want = brute(rows, 2.0)
    for r in got.collect():
        assert [r["u__y"], r["u__z"], r["v__y"], r["v__z"]] == pytest.approx(want[r["id"]])


def test_no_row_sees_its_own_target(spark):
    rows = rows_of(4, 120)
    schema = "id long, u string, v string, y double, z double"
    code = lambda rs: {r["id"]: r["u__y"] for r in O.ordered_codes(spark.createDataFrame(rs, schema), ["u"], ["y"], ["id"]).collect()}
    first = code(rows)
    for i in (0, 57, 119):
        changed = code([(*r[:3], 1e6, r[4]) if r[0] == i else r for r in rows])
        assert changed[i] == first[i] and changed != first


def test_new_rows_get_the_mean_of_all(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 8.0)], "u string, y double")
    codes = O.TargetCodes.fit(df, ["u"], ["y"], strength=1.0)
    got = {r["u"]: r["u__y"] for r in codes.transform(spark.createDataFrame([("a",), (None,), ("new",)], "u string")).collect()}
    assert got == {"a": pytest.approx((4 + 4) / 3), None: pytest.approx((8 + 4) / 2), "new": 4.0}
    assert O.ordered_codes(df.where("false"), ["u"], ["y"], ["u"]).collect() == []


def test_coded_trees_know_a_category_by_its_target(spark, tmp_path):
    draw = random.Random(1)
    rows = [(i, f"level {draw.randrange(60)}", draw.random()) for i in range(2_000)]
    df = spark.createDataFrame(rows, "id long, level string, noise double")
    df = df.withColumn("y", F.when(F.xxhash64("level") % 2 == 0, "even").otherwise("odd")).repartition(4)
    params = {**L.DEFAULTS["boosted_codes"], "learning_rate": .5, "max_depth": 3}
    fitted = L.fit("boosted_codes", "classification", params, df, "y", ["level", "noise"], ["even", "odd"], key=["id"], max_trees=6)
    L.save(fitted, str(tmp_path / "m"))
    for model in (fitted, L.load(str(tmp_path / "m"))):
        preds = model.predict(df.select("level", "noise", L.label_index(["even", "odd"], F.col("y")).alias("label")))
        assert L.score("accuracy", preds) > .95
