"""Guided settings: better than plain draws on a planted response, and side by side without losing a trial."""

import math
import random
import statistics

import pytest

from tablewright.operators import tuning


def response(settings):
    """A narrow hill where a small rate goes with deep trees."""
    rate, depth = math.log(settings["learning_rate"]), settings["max_depth"]
    return -(rate - math.log(.12)) ** 2 - .1 * (depth - 5) ** 2 - 2 * (settings["subsample"] - .7) ** 2 - .3 * (rate - math.log(.12)) * (depth - 5)


def valley(settings):
    """Shares that must agree, at a rate near the low end."""
    return -8 * (settings["subsample"] - settings["column_share"]) ** 2 - .5 * (math.log(settings["learning_rate"]) - math.log(.02)) ** 2


def found(seed, guide, response=response):
    kept = tuning.GUIDED_AFTER, tuning.STARTS["boosted"]
    try:
        tuning.STARTS["boosted"] = []
        tuning.GUIDED_AFTER = 10 if guide else 10 ** 6
        return tuning.search("boosted", lambda s, k: response(s), 1, 50, {}, -99.0, budget=30, min_gain=-1e9, seed=seed)
    finally:
        tuning.GUIDED_AFTER, tuning.STARTS["boosted"] = kept


@pytest.mark.parametrize("planted", [response, valley])
def test_best_of_thirty_beats_draws(planted):
    drawn, guided = [found(s, False, planted) for s in range(20)], [found(s, True, planted) for s in range(20)]
    assert statistics.fmean(g.score for g in guided) > statistics.fmean(d.score for d in drawn)
    assert sum(g.score >= d.score for g, d in zip(guided, drawn)) >= 14
    assert all([t.origin for t in g.trials] == ["drawn"] * 10 + ["guided"] * 20 for g in guided)


def test_guided_settings_stay_in_their_ranges():
    rng = random.Random(3)
    for name, ranges in tuning.RANGES.items():
        trials = [tuning.Trial("drawn", tuning.draw(name, rng), [rng.random()], 1, "whole") for _ in range(15)]
        for _ in range(20):
            settings = tuning.guided(name, trials, rng)
            assert list(settings) == list(ranges)
            for s, span in ranges.items():
                assert settings[s] in span if isinstance(span, list) else span[0] <= settings[s] <= span[1]


def test_trials_side_by_side_are_all_told(spark):
    out = tuning.search("kernel", lambda s, k: -abs(math.log(s["C"])), 2, 50, {"C": 9.0, "gamma": .1}, -9.0, budget=12, min_gain=-1e9, parallelism=4)
    assert 12 <= len(out.trials) <= 16 and all(t.outcome in ("whole", "given up") for t in out.trials)
    assert out.score == max(t.score for t in out.trials if t.score is not None)
    assert {r["origin"] for r in out.table(spark).collect()} == {"default", "listed", "drawn", "guided"}
