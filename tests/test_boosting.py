"""Boosted trees: first trees against plain search, early stop against a full fit, best-first shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import boosting as B


def planted(n=3_000, seed=4):
    draw = np.random.default_rng(seed)
    x = np.stack([draw.integers(0, 30, n), draw.normal(size=n).round(3), draw.integers(0, 4, n)], 1).astype(float)
    y = np.where(x[:, 0] > 11, 3.0, 0) + np.where((x[:, 0] > 11) & (x[:, 1] > .4), 5.0, 0) + x[:, 2] * (x[:, 0] <= 3) + draw.normal(size=n)
    return x, y


def table(spark, x, y, held=None, model=0, w=None):
    held = np.zeros(len(y), bool) if held is None else held
    w = np.ones(len(y)) if w is None else w
    rows = [(model, i, a.tolist(), float(b), float(c), bool(h)) for i, (a, b, c, h) in enumerate(zip(x, y, w, held))]
    return spark.createDataFrame(rows, "model int, id long, x array<double>, y double, w double, held boolean").repartition(4)


def plain_tree(bins, g, h, penalty, leaves=None, depth=99):
    """Splits (feature, cut, gain) in the order they are taken, by counting every cut of every leaf."""
    def best(rows):
        found = None
        worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + penalty)
        for f in range(bins.shape[1]):
            for cut in range(bins[:, f].max()):
                left = rows & (bins[:, f] <= cut)
                right = rows & ~left & rows
                if left.any() and right.any():
                    gain = worth(left) + worth(right) - worth(rows)
                    if gain > 1e-9 and (found is None or gain > found[0] * (1 + 1e-9)):
                        found = (gain, f, cut, left, right)
        return found
    open_, out = [best(np.ones(len(g), bool))], []
    while open_ and len(out) + 1 < leaves:
        open_.sort(key=lambda s: -s[0])
        gain, f, cut, left, right = open_.pop(0)
        out.append((f, cut, gain))
        open_ += [s for s in (best(left), best(right)) if s]
    return out


@pytest.mark.parametrize("leaves", [2, 5, 9])
def test_first_tree_best_leaf_first(spark, leaves):
    x, y = planted(600)
    fitted = B.boost(table(spark, x, y), 3, B.Settings(leaves=leaves, depth=50, learning_rate=1.0), 1)[0]
    tree = fitted.trees[0]
    assert tree.leaf_count == leaves and fitted.base == pytest.approx(y.mean())
    bins = fitted.binned(x)
    want = plain_tree(bins, fitted.base - y, np.ones(len(y)), 1.0, leaves)
    got = sorted((f, c, round(g, 4)) for f, c, g in zip(tree.feature, tree.cut, tree.gain) if f >= 0)
    assert got == sorted((f, c, round(g, 4)) for f, c, g in want)
    assert sum(r for r, f in zip(tree.rows, tree.feature) if f < 0) == len(y)


def test_scores_are_the_sums_of_leaf_means(spark):
    """With every value a leaf, no penalty and rate r, T trees leave (1 - r) ** T of each value's distance from the mean."""
    draw = np.random.default_rng(0)
    x = draw.integers(0, 6, (500, 1)).astype(float)
    y = x[:, 0] ** 2 + draw.normal(size=500)
    fitted = B.boost(table(spark, x, y), 1, B.Settings(leaves=6, depth=50, learning_rate=.2, penalty=0.0), 15, trees_per_write=4)[0]
    assert len(fitted.trees) == 15
    want = [y.mean() + (y[x[:, 0] == v].mean() - y.mean()) * (1 - .8 ** 15) for v in range(6)]
    assert fitted.raw(np.arange(6.0)[:, None]) == pytest.approx(want)


def test_early_stop_takes_the_best_of_a_full_fit(spark):
    x, y = planted()
    held = np.arange(len(y)) % 5 == 0
    settings = B.Settings(depth=4, learning_rate=.3)
    whole = B.boost(table(spark, x, y, held), 3, settings, 40, patience=None)[0]
    losses = [((whole.raw(x[held], n) - y[held]) ** 2).mean() for n in range(41)]
    best = int(np.argmin(losses))
    assert 0 < best < 30
    stopped = B.boost(table(spark, x, y, held), 3, settings, 3_000, patience=10, trees_per_write=3)[0]
    assert len(stopped.trees) == best
    assert stopped.losses[:best + 1] == pytest.approx(losses[:best + 1])


def test_models_side_by_side_are_those_alone(spark):
    x, y = planted(800)
    up = (y > 2).astype(float)
    settings = B.Settings(logistic=True, depth=3, learning_rate=.3, subsample=.8, column_share=.7)
    both = B.boost(table(spark, x, up).union(table(spark, x[:500], up[:500], model=3)), 3, settings, {0: 3, 3: 6})
    alone = B.boost(table(spark, x[:500], up[:500]), 3, settings, 6)[0]
    assert [len(both[m].trees) for m in (0, 3)] == [3, 6]
    assert both[3].raw(x) == pytest.approx(alone.raw(x))
    again = B.Ensemble.from_json(alone.to_json())
    assert again.raw(x).tolist() == alone.raw(x).tolist()
    shown = spark.createDataFrame([(a.tolist(),) for a in x[:50]], "x array<double>").select(B.raw_scores(F.col("x"), [alone], spark).alias("r"))
    assert [r["r"][0] for r in shown.collect()] == pytest.approx(alone.raw(x[:50]).tolist())


def test_weights_constant_targets_and_no_rows(spark):
    x, y = planted(200)
    fitted = B.boost(table(spark, x, np.full(200, 7.0)), 3, B.Settings(), 5)[0]
    assert fitted.trees == [] and fitted.base == 7.0
    assert B.boost(table(spark, x, y).where("false"), 3, B.Settings(), 5) == {}
    w = np.where(np.arange(200) < 100, 1.0, 0.0)
    weighted = B.boost(table(spark, x, y, w=w), 3, B.Settings(depth=2, least_curvature=1.0), 2)[0]
    assert weighted.base == pytest.approx(y[:100].mean())


@pytest.mark.parametrize("logistic", [False, True])
def test_rows_of_equal_bins_are_one_cell(spark, logistic):
    """Ten copies of every row in other tasks are as many cells as one, and their trees are those of ten times the weight."""
    x, y = planted(400)
    y = (y > 2).astype(float) if logistic else y
    held = np.arange(len(y)) % 5 == 0
    copies = table(spark, np.tile(x, (10, 1)), np.tile(y, 10), np.tile(held, 10), w=np.full(4_000, 2.0))
    edges = B.bin_edges(copies, 3)
    count = B.to_cells(copies, edges, 3, False).count()
    assert count == B.to_cells(table(spark, x, y, held), edges, 3, False).count() <= 400
    assert count < B.to_cells(copies, edges, 3, True).count() < 4_000
    settings = B.Settings(logistic=logistic, depth=3, learning_rate=.3)
    many = B.boost(copies, 3, settings, 6, patience=None)[0]
    one = B.boost(table(spark, x, y, held, w=np.full(400, 20.0)), 3, settings, 6, patience=None)[0]
    assert many.edges == one.edges and many.raw(x) == pytest.approx(one.raw(x)) and many.losses == pytest.approx(one.losses)
    assert many.trees[0].rows[0] == 10 * one.trees[0].rows[0]


@pytest.mark.parametrize("settings", [B.Settings(depth=4, learning_rate=.3), B.Settings(logistic=True, leaves=7, depth=7, subsample=.7, column_share=.7, learning_rate=.3)])
def test_a_model_in_one_task_is_the_one_of_passes(spark, monkeypatch, settings):
    """The same trees and losses either way, early stop included, and no job per level where the cells are few."""
    x, y = planted(900)
    y = (y > 2).astype(float) if settings.logistic else y
    held = np.arange(len(y)) % 5 == 0
    rows = table(spark, x, y, held).union(table(spark, x[:400], y[:400], model=2))
    passes = B.boost(rows, 3, settings, {0: 60, 2: 4}, patience=4, trees_per_write=3, cells_per_task=0)
    mixed = B.boost(rows, 3, settings, {0: 60, 2: 4}, patience=4, cells_per_task=B.to_cells(table(spark, x[:400], y[:400]), B.bin_edges(rows, 3), 3, settings.subsample < 1).count())
    monkeypatch.setattr(B, "_ask", lambda *a: pytest.fail("a pass over all blocks"))
    tasks = B.boost(rows, 3, settings, {0: 60, 2: 4}, patience=4)
    for found in (mixed, tasks):
        for m in (0, 2):
            assert [(t.feature, t.cut, t.rows) for t in found[m].trees] == [(t.feature, t.cut, t.rows) for t in passes[m].trees]
            assert found[m].raw(x) == pytest.approx(passes[m].raw(x)) and found[m].losses == pytest.approx(passes[m].losses)
    assert len(tasks[2].trees) == 4 and 0 < len(tasks[0].trees) < 60


def test_scores_looked_up_by_bins_are_those_of_the_trees(spark):
    x, y = planted(600)
    fitted = B.boost(table(spark, x, y), 3, B.Settings(depth=3, learning_rate=.3), 5)[0]
    scorer = B._Scorer(fitted)
    assert [scorer(x).tolist() for _ in range(40)] == [fitted.raw(x).tolist()] * 40
    assert scorer.known is not None and len(scorer.known) == scorer.kinds


def test_features_of_few_values_need_no_quantiles(spark, monkeypatch):
    x, y = planted(600)
    rows = table(spark, x, y)
    asked = []
    quantiles = B.F.percentile_approx
    monkeypatch.setattr(B.F, "percentile_approx", lambda c, *a: asked.append(c) or quantiles(c, *a))
    edges = B.bin_edges(rows, 3)[0]
    assert edges[0] == sorted(set(x[:, 0]))[:-1] and edges[2] == sorted(set(x[:, 2]))[:-1] and len(edges[1]) == 63 and len(asked) == 1
