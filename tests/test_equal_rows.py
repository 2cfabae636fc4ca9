"""Tables with many copies of few rows: models see each kind of row once, with the weight of all."""

import numpy as np
import pytest

from tablewright.operators import models as L


def copies(spark, times):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(600, 2)).round(4)
    rows = [(float(a), float(b), "in" if a * a + b * b < 1.2 else "out", i) for i, (a, b) in enumerate(x.tolist() * times)]
    return spark.createDataFrame(rows, "a double, b double, y string, id int").repartition(4)


def test_copies_take_no_landmarks_away(spark):
    """Equal rows share one draw; counted one by one they left a twentieth of the landmarks here."""
    fitted = L.fit("kernel", "classification", L.DEFAULTS["kernel"], copies(spark, 20), "y", ["a", "b"], ["in", "out"])
    assert len(fitted.kernel.landmarks) > 128


def test_copies_weigh_what_they_are(spark):
    once, often = (L.fit("linear", "classification", {"strength": s}, copies(spark, n), "y", ["a", "b"], ["in", "out"]) for n, s in ((1, 1.0), (5, 0.2)))
    assert often.model.coefficients.toArray() == pytest.approx(once.model.coefficients.toArray(), abs=1e-4)
    assert L._equal_rows(often.encoder.transform(L._weighted(copies(spark, 5), "classification", "y", ["in", "out"], False))).count() == 600


@pytest.mark.parametrize("task,target,labels,score", [("classification", "y", ["in", "out"], "accuracy"), ("regression", "r", [], "r2")])
def test_a_forest_reads_rows_of_equal_bins_as_few(spark, monkeypatch, tmp_path, task, target, labels, score):
    read = []
    maker = L.RandomForestClassifier if labels else L.RandomForestRegressor
    fit = maker.fit
    monkeypatch.setattr(maker, "fit", lambda self, df: read.append(df.agg({"*": "count", "__weight": "sum"}).first()) or fit(self, df))
    rows = copies(spark, 40).selectExpr("*", "if(id % 600 = 7, null, a) AS gap", "1.5D AS same", "int(y = 'in') AS r")
    fitted = L.fit("forest", task, L.DEFAULTS["forest"], rows, target, ["gap", "b", "same"], labels, key=["id"], max_trees=5)
    assert read[0]["count(1)"] <= 600 * 16 and read[0]["sum(__weight)"] == 24_000
    L.save(fitted, f"{tmp_path}/forest")
    y = L.label_index(labels, rows["y"]) if labels else rows["r"]
    for model in (fitted, L.load(f"{tmp_path}/forest")):
        assert L.score(score, model.predict(rows.select("gap", "b", "same", y.alias("label")))) > (0.9 if labels else 0.7)
