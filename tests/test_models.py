"""Model candidates: invariants on planted data, tuning rules, and round trips."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import cleaning as C
from tablewright.operators import models as L
from tablewright.operators import sampling as S
from tablewright.operators import scoring
from tablewright.operators import tuning
from tablewright.operators.features import Encoder, engineer
from tablewright.operators.task import TaskError
from tablewright.operators.training import sweep


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        age, bmi, smoker = rng.randint(18, 64), round(rng.gauss(30, 6), 2), rng.choice(["yes", "no", "no", "no"])
        region = rng.choice(["north", "south", "east", "west"])
        charges = 250 * age + 300 * bmi + (22000 if smoker == "yes" else 0) + rng.gauss(0, 2000)
        rows.append((i, age, bmi if i % 20 else None, smoker, region, charges, "2024-01-%02d" % (1 + i % 28)))
    schema = "id bigint, age int, bmi double, smoker string, region string, charges double, day string"
    return spark.createDataFrame(rows, schema).repartition(4).cache()


FEATURES = ["age", "bmi", "smoker", "region"]


def test_logistic_matches_the_textbook_penalty(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = (x + rng.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame([(float(a), "yes" if b else "no") for a, b in zip(x, y)], "x double, y string")
    fitted = L.fit("linear", "classification", {"strength": 0.05}, df, "y", ["x"], ["no", "yes"])
    z = (x - x.mean()) / x.std()
    w, b = 0.0, 0.0  # minimise C * sum(log loss) + w^2 / 2 by Newton's method
    for _ in range(50):
        p = 1 / (1 + np.exp(-(w * z + b)))
        g = np.array([0.05 * ((p - y) * z).sum() + w, 0.05 * (p - y).sum()])
        h = 0.05 * np.array([[(p * (1 - p) * z * z).sum(), (p * (1 - p) * z).sum()], [(p * (1 - p) * z).sum(), (p * (1 - p)).sum()]])
        h[0, 0] += 1
        w, b = np.array([w, b]) - np.linalg.solve(h, g)
    assert fitted.model.coefficients[0] == pytest.approx(w, abs=1e-3)


@pytest.mark.parametrize("name", ["boosted", "leafwise", "forest", "boosted_codes", "kernel", "neighbours", "linear"])
@pytest.mark.parametrize("task,target,features,floor", [
    ("regression", "charges", FEATURES, 0.5), ("classification", "smoker", ["age", "bmi", "charges", "region"], 0.8)])
def test_every_family_beats_the_baseline(people, name, task, target, features, floor):
    labels = ["no", "yes"] if task == "classification" else []
    params = dict(L.DEFAULTS[name])
    if "learning_rate" in params:
        params.update({"learning_rate": 0.5, **({"max_leaves": 8} if "max_leaves" in params else {"max_depth": 3})})
    train, test = people.filter("id % 4 <> 0"), people.filter("id % 4 = 0")
    fitted = L.fit(name, task, params, train, target, features, labels, key=["id"], max_trees=8)
    y = L.label_index(labels, F.col(target)) if labels else F.col(target)
    preds = fitted.predict(test.select(*features, y.alias("label")))
    assert preds.count() == test.count()
    assert L.score("accuracy" if labels else "r2", preds) > floor


def test_three_classes_by_one_against_the_rest(people):
    three = people.withColumn("y", F.when(F.col("charges") < 15000, "a").when(F.col("charges") < 25000, "b").otherwise("c"))
    for name in ("boosted", "kernel", "linear"):
        params = {**L.DEFAULTS[name], **({"learning_rate": 0.5, "max_depth": 3} if name == "boosted" else {})}
        fitted = L.fit(name, "classification", params, three, "y", FEATURES, ["a", "b", "c"], key=["id"], max_trees=5)
        preds = fitted.predict(three.select(*FEATURES, L.label_index(["a", "b", "c"], F.col("y")).alias("label")))
        assert L.score("accuracy", preds) > 0.6


def test_encoders_see_only_the_training_fold(people):
    train = people.filter("region <> 'west'")
    encoder = Encoder.fit(train, ["region", "age"], "tree")
    assert encoder.names() == ["age", "region_east", "region_north", "region_south"]
    row = encoder.transform(people.filter("region = 'west'")).first()
    assert list(row["features"].toArray()[1:]) == [0.0, 0.0, 0.0]  # an unknown level is all zero
    codes = Encoder.fit(train, ["region"], "ordinal")
    assert codes.transform(people.filter("region = 'west'")).first()["features"][0] == -1.0


def test_long_level_lists_are_joined(spark, tmp_path, monkeypatch):
    from tablewright.operators import features
    monkeypatch.setattr(features, "LITERAL_LEVELS", 5)
    df = spark.range(40).select(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("s"))
    encoder = Encoder.fit(df, ["s"], "ordinal")
    assert list(encoder.tables) == ["s"]
    encoder.save(spark, str(tmp_path))
    for e in (encoder, Encoder.load(spark, str(tmp_path))):
        got = {r["s"]: r["features"][0] for r in e.transform(df.union(spark.createDataFrame([("zz",)], "s string"))).collect()}
        assert got["v00"] == 0 and got["v39"] == 39 and got["zz"] == -1


def test_rare_levels_are_pooled(spark):
    df = spark.range(600).select(F.concat(F.lit("l"), (F.sqrt("id")).cast("int").cast("string")).alias("s"))
    encoder = Encoder.fit(df, ["s"], "scaled")
    assert encoder.pooled == ["s"] and len(encoder.names()) == 20
    row = encoder.transform(spark.createDataFrame([("new",)], "s string")).first()
    assert row["features"].toArray()[-1] == 1.0


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_bundle_round_trip_scores_alike(spark, people, tmp_path, task):
    target = "smoker" if task == "classification" else "charges"
    spec = C.CleaningSpec(date_parts={"day": ["day_of_week"]}, new_columns=[C.NewColumn("ratio", "bmi / age")])
    done = engineer(people, target, spec, ["id"])
    labels = L.class_labels(done.table, target) if task == "classification" else []
    assert "day" in done.input_columns and "day__day_of_week" in done.model_columns
    name = "boosted" if task == "regression" else "linear"
    fitted = L.fit(name, task, L.DEFAULTS[name], done.table, target, done.model_columns, labels, max_trees=3)
    bundle = scoring.Bundle(fitted, done.spec, scoring.inputs_of(people, done.input_columns))
    bundle.save(str(tmp_path / "b"))
    again = scoring.Bundle.load(str(tmp_path / "b"))
    first, second = scoring.score(people, bundle), scoring.score(people, again)
    assert set(people.columns) <= set(first.columns)
    assert sorted(map(str, first.collect())) == sorted(map(str, second.collect()))
    if task == "classification":
        assert {"probability_no", "probability_yes"} <= set(first.columns)
        assert {r[0] for r in first.select("prediction").distinct().collect()} <= {"no", "yes"}
    with pytest.raises(scoring.MissingInputs, match="age"):
        scoring.score(people.drop("age"), bundle)
    records = scoring.from_records(people.select("age", "region"), bundle)
    assert records.columns == [c for c, _ in bundle.inputs]
    assert scoring.score(records, bundle).count() == 600
    with pytest.raises(scoring.MissingInputs):
        scoring.from_rows(spark, people.select("age"), bundle)


def test_scoring_has_no_shuffle(people, capsys):
    fitted = L.fit("linear", "regression", {"strength": 1.0}, people, "charges", FEATURES)
    bundle = scoring.Bundle(fitted, C.CleaningSpec(missing_codes={"age": [0]}), scoring.inputs_of(people, FEATURES))
    raw = people.sparkSession.createDataFrame([(30, 25.0, "yes", "east")], "age int, bmi double, smoker string, region string")
    scoring.score(raw, bundle).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_baseline_of_a_constant_guess(people):
    folds = S.with_folds(people, "smoker", ["id"], folds=3).cache()
    for r in L.baseline_cv(folds, "smoker", "classification").collect():
        held = folds.filter(F.col("fold") == r["fold"])
        assert r["usual"] == "no"
        assert r["score"] == pytest.approx(held.filter("smoker = 'no'").count() / held.count(), abs=1e-6)
    for r in L.baseline_cv(folds, "charges", "regression").collect():
        assert -0.1 < r["score"] <= 0


def test_sweep_picks_tunes_and_reports(people):
    table = people.select(*FEATURES, "charges", "id")
    found = sweep(table, "charges", "regression", ["forest", "linear"], ["id"], tuning_budget=1, max_trees=5)
    assert found.metric == "r2" and found.beats_baseline and found.test_score > 0.5
    assert found.candidates.filter("status = 'ok'").count() == 2 and found.trials.count() > 1
    assert found.predictions.count() == 120
    names = {r["feature"] for r in L.importances(found.champion).collect()}
    assert any(n.startswith("smoker") for n in names)


def test_sweep_logs_what_it_skips(people):
    table = people.select("age", "bmi", "smoker", "id")
    with pytest.raises(TaskError):
        sweep(table, "smoker", "classification", ["linear"], ["id"], time_budget=-1.0)


# -- tuning ----------------------------------------------------------------------------------------------


def told(scores):
    """A fold score that reads a script: one list per trial, in the order they are tried."""
    script, seen = iter(scores), []

    def fold_score(settings, fold):
        if not seen or seen[-1][0] is not settings:
            seen.append((settings, next(script)))
        value = seen[-1][1][fold]
        if isinstance(value, Exception):
            raise value
        return value
    return fold_score


def ends(found):
    return [(t.folds, t.outcome) for t in found.trials]


def test_halving_keeps_the_best_third_at_each_rung():
    runs = [[0.5] * 5, [0.4] * 5, [0.6, 0.6, 0.2, 0, 0], [0.7] * 5, [0.65] * 5]
    found = tuning.search("linear", told(runs), 5, tuning.HALVING_FOLD_ROWS, {"strength": 1.0}, 0.1, budget=3)
    # The first is alone; 0.4 is behind it; 0.6 leads, then falls behind at the second rung; 0.7 leads to its end.
    assert ends(found) == [(5, "whole"), (1, "given up"), (3, "given up"), (5, "whole"), (1, "given up")]
    assert found.score == 0.7 and found.params == found.trials[3].settings


def test_median_needs_whole_trials_and_some_folds():
    runs = [[v] * 4 for v in (0.5, 0.6, 0.7, 0.8)] + [[0.9, 0.9, 0.0, 0.9], [0.64] * 4]
    found = tuning.search("linear", told(runs), 4, 50, {"strength": 1.0}, 0.0, budget=6)
    assert ends(found)[:4] == [(4, "whole")] * 4  # too few to compare with
    assert ends(found)[4:6] == [(3, "given up"), (3, "given up")]


def test_a_broken_setting_costs_its_fold_and_is_told():
    runs = [[0.2, ValueError("odd"), 0.2], [0.3] * 3]
    found = tuning.search("linear", told(runs), 3, 50, {"strength": 1.0}, 0.25, budget=1.5)
    assert ends(found) == [(2, "failed"), (3, "whole")]
    assert found.trials[0].error == "odd" and found.score == 0.3


def test_patience_counts_drawn_folds_since_the_last_gain():
    flat = tuning.search("kernel", lambda s, k: 0.4, 2, 50, {"C": 1.0, "gamma": 1.0}, 0.4, budget=500, min_gain=0.01)
    listed = len(tuning.STARTS["kernel"])
    assert [t.origin for t in flat.trials[:listed]] == ["listed"] * listed
    assert sum(t.folds for t in flat.trials[listed:]) == tuning.PATIENCE * 2
    assert flat.idle == tuning.PATIENCE * 2 and flat.params == {"C": 1.0, "gamma": 1.0}
    rising = iter(range(1000))
    growing = tuning.search("kernel", lambda s, k: next(rising), 2, 50, {"C": 1.0, "gamma": 1.0}, -1.0, budget=30)
    assert growing.spent == 60 and growing.idle == 0


def test_log_has_the_defaults_first(spark):
    found = tuning.search("linear", told([[0.3] * 2]), 2, 50, {"strength": 1.0}, 0.25, budget=0.5)
    rows = found.table(spark).orderBy("trial").collect()
    assert [(r["trial"], r["origin"], r["score"]) for r in rows] == [(0, "default", 0.25), (1, "listed", 0.3)]


@pytest.mark.parametrize("name", sorted(tuning.RANGES))
def test_settings_are_whole_and_in_range(name):
    source = tuning.proposals(name, 7)
    for _ in range(30):
        _, settings = next(source)
        assert list(settings) == list(tuning.RANGES[name]) == list(L.DEFAULTS[name])
        for setting, value in settings.items():
            span = tuning.RANGES[name][setting]
            assert value in span if isinstance(span, list) else span[0] <= value <= span[1]
    assert next(tuning.proposals(name, 1)) == next(tuning.proposals(name, 2))


def test_noise_shrinks_with_folds():
    assert tuning.noise([3.0, 5.0]) == pytest.approx(2 ** -0.5)
    assert tuning.noise([3.0, 5.0] * 8) == pytest.approx(0.25)


def test_fits_of_a_search_share_the_rows_of_their_folds(people, monkeypatch):
    data = S.with_folds(people.select(*FEATURES, "smoker", "id"), "smoker", ["id"], folds=2)
    made = []
    fit = L.Encoder.fit
    monkeypatch.setattr(L.Encoder, "fit", lambda *a: made.append(a) or fit(*a))
    features = [c for c in FEATURES if c != "smoker"]
    with L.FoldScores("linear", "classification", data, "smoker", features, 2, "accuracy", ["no", "yes"], key=["id"]) as shared:
        got = [shared({"strength": s}, k) for s in (0.01, 10.0) for k in (0, 1)]
    assert len(made) == 2
    assert got == [L.fold_score("linear", "classification", {"strength": s}, data, "smoker", features, k, "accuracy", ["no", "yes"], key=["id"])
                   for s in (0.01, 10.0) for k in (0, 1)]


def test_trials_side_by_side_keep_to_the_budget():
    def slow(settings, fold):
        time.sleep(0.02 * (1 + settings["strength"] % 3))
        return 0.4
    found = tuning.search("linear", slow, 5, 50, {"strength": 1.0}, 0.4, budget=4, parallelism=4)
    assert ends(found) == [(5, "whole")] * 4
    assert [t.origin for t in found.trials] == ["listed"] * 3 + ["drawn"]


def test_a_forest_never_reads_all_rows_in_one_task(people, monkeypatch):
    parts = []
    fit = L.RandomForestClassifier.fit
    monkeypatch.setattr(L, "FOREST_TASK_ROWS", 100, raising=False)
    monkeypatch.setattr(L.RandomForestClassifier, "fit", lambda self, df: parts.append(df.rdd.getNumPartitions()) or fit(self, df))
    fitted = L.fit("forest", "classification", L.DEFAULTS["forest"], people.coalesce(1), "smoker", ["charges", "age"], ["no", "yes"], max_trees=3)
    assert parts == [6] and L.importances(fitted).first()["feature"] == "charges"
