"""The registered search is a whole one: measured default, rows of its folds, noise as the least gain, all kinds of settings."""

import statistics

import pytest

from tablewright.operators import models as L
from tablewright.operators import tuning
from tablewright.plans import model_plans


@pytest.fixture(scope="module")
def clients(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("clients")
    rows = [(i, float(i * 37 % 9000), ["BUILDING", "MACHINERY", "AUTOMOBILE"][i % 3], i % 25) for i in range(403)]
    spark.createDataFrame(rows, "c_custkey bigint, c_acctbal double, c_mktsegment string, c_nationkey int").write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_the_search_is_whole(spark, clients, monkeypatch):
    asked, found, scores = [], [], {}
    search, call = tuning.search, L.FoldScores.__call__

    def seen(*a, **k):
        asked.append((a, k))
        found.append(search(*a, **k))
        return found[0]

    def told(self, params, fold):
        got = call(self, params, fold)
        if not asked:
            scores[fold] = (dict(params), got)
        return got
    monkeypatch.setattr(tuning, "search", seen)
    monkeypatch.setattr(L.FoldScores, "__call__", told)
    rows = model_plans.tuning_log(spark, clients).orderBy("trial").collect()
    assert [tuple(r) for r in rows] == [(t, o, 5, "median", True, True) for t, o in ((0, "default"), (1, "listed"), (4, "searched"))]
    (_, _, folds, fold_rows, defaults, start), how = asked[0]
    default = [scores[k][1] for k in range(5)]
    assert [scores[k][0] for k in range(5)] == [defaults] * 5 and folds == 5
    assert start == statistics.fmean(default) and how["min_gain"] == tuning.noise(default) and fold_rows in (79, 80)
    assert how["budget"] == 20 and (found[0].idle >= 25 or found[0].promised >= 100)
    assert [t.origin for t in found[0].trials[:3]] == ["listed"] * 3 and "guided" in {t.origin for t in found[0].trials}


def test_guided_after_the_listed_settings():
    out = tuning.search("linear", lambda s, k: 0.4, 2, 50, {"strength": 1.0}, 0.4, budget=20, guided_after=3)
    assert [t.origin for t in out.trials] == ["listed"] * 3 + ["guided"] * 5
    plain = tuning.search("linear", lambda s, k: 0.4, 2, 50, {"strength": 1.0}, 0.4, budget=20)
    assert [t.origin for t in plain.trials] == ["listed"] * 3 + ["drawn"] * 5


def test_where_trials_end():
    def trial(outcome, folds):
        return tuning.Trial("drawn", {}, [0.1] * folds, folds, outcome)
    assert [n for n in range(1, 6) if tuning.ended_by(trial("given up", n), 5, tuning.halving)] == [1, 3]
    assert [n for n in range(1, 6) if tuning.ended_by(trial("given up", n), 5, tuning.median)] == [3, 4]
    assert [n for n in range(1, 6) if tuning.ended_by(trial("whole", n), 5, tuning.median)] == [5]
    assert not tuning.ended_by(trial("failed", 5), 5, tuning.median) and tuning.rule_of(10_000) is tuning.halving
