"""Trees on counted cells, against splits written out by hand and by brute force."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import functions as F

from stipendia import session
from stipendia.ml import trees
from stipendia.ml.trees import Growth, Model

COLUMNS = ["fold", "features", "_count", "_mean", "_sum", "_squares"]


def frame(spark, x, y, n, fold=None):
    rows = []
    for i in range(len(y)):
        some = np.flatnonzero(x[i])
        vector = Vectors.sparse(x.shape[1], some.tolist(), x[i, some].tolist()) if i % 2 else Vectors.dense(x[i])
        rows.append((int(fold[i]) if fold is not None else 0, vector, float(n[i]), float(y[i]),
                     float(n[i] * y[i]), float(n[i] * y[i] ** 2)))
    return spark.createDataFrame(rows, COLUMNS)


def by_hand(x, y, n, depth, growth, at=None):
    """A tree as nested tuples (input, value left at most, left, right), or the value of a leaf."""
    at = np.arange(len(y)) if at is None else at
    h, g = n[at].sum(), (n * y)[at].sum()
    leaf = g / (h + growth.l2)
    best = (growth.least_gain, None)
    if depth and h >= growth.least_split:
        for f in range(x.shape[1]):
            for cut in np.unique(x[at, f])[:-1]:
                left = at[x[at, f] <= cut]
                lh, lg = n[left].sum(), (n * y)[left].sum()
                if min(lh, h - lh) < growth.least_leaf:
                    continue
                gain = (lg**2 / (lh + growth.l2) + (g - lg)**2 / (h - lh + growth.l2) - g**2 / (h + growth.l2)) / 2
                if gain > best[0] + 1e-9 * max(1, abs(best[0])):
                    best = (gain, (f, cut))
    if best[1] is None:
        return leaf
    f, cut = best[1]
    return f, cut, by_hand(x, y, n, depth - 1, growth, at[x[at, f] <= cut]), \
        by_hand(x, y, n, depth - 1, growth, at[x[at, f] > cut])


def hand_predicted(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def test_a_small_tree_worked_out(spark):
    # Targets around their mean 3: -3 (two records), -1, 4, 3 (no: -3*2 - 1 + 4 + 3 = 0). The best first cut is
    # between 1 and 2: 49 / (3 + 1) + 49 / (2 + 1) over 2 = 14.29.
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    data = trees.binned(frame(spark, x, np.array([0.0, 2.0, 7.0, 6.0]), np.array([2.0, 1.0, 1.0, 1.0])))
    assert data.cuts.tolist() == [0.5, 1.5, 2.5, np.inf]
    model, = trees.boost(data, [Model(Growth(2, l2=1.0, records=1.0), 1, 0.5)])
    assert model.start == 3.0
    tree = model.grown[0]
    assert tree.feature[0, 0] == 0 and data.cuts[tree.bin[0, 0]] == 1.5
    assert tree.gain[0, 0] == pytest.approx((49 / 4 + 49 / 3) / 2)
    # Left: -6 of 2 and -1 of 1: 36/3 + 1/2 - 49/4 = 0.25 gained; right: 4 and 3: 16/2 + 9/2 - 49/3 < 0.
    assert sorted(tree.gain[0][tree.gain[0] != 0]) == pytest.approx([0.125, (49 / 4 + 49 / 3) / 2])
    ends = tree.predicted(np.arange(4)[:, None])[:, 0]
    assert ends == pytest.approx([-2, -0.5, 7 / 3, 7 / 3])
    firm, = trees.boost(data, [Model(Growth(2, l2=1.0, least_gain=0.2, records=1.0), 1, 0.5)])
    assert (firm.grown[0].feature >= 0).sum() == 1


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    n = 160
    x = np.zeros((n, 7))
    x[np.arange(n), rng.integers(0, 4, n)] = 1
    x[:, 4] = rng.integers(0, 6, n)
    x[:, 5] = rng.normal(0, 1, n).round(2)
    x[:, 6] = 3.0
    y = 11 + x[:, 0] + 0.3 * x[:, 4] * (x[:, 1] > 0) + np.sin(2 * x[:, 5]) + rng.normal(0, .1, n)
    count, fold = rng.integers(1, 30, n).astype(float), rng.integers(0, 3, n)
    return frame(spark, x, y, count, fold), x, y, count, fold


@pytest.mark.parametrize("growth", [
    Growth(4, least_split=50, records=1.0), Growth(3, l2=2.0, least_gain=0.5, least_leaf=20, records=1.0)])
def test_trees_take_the_best_splits(sample, growth):
    df, x, y, n, fold = sample
    data = trees.binned(df, "fold", "_sum", "_squares")
    assert len(data.zero) == 7 and data.cells == 160
    centre = 0.0 if growth.l2 == 0 else np.average(y, weights=n)
    wanted = by_hand(x, y - centre, n, growth.depth, growth)
    if growth.l2 == 0:
        found, = trees.forest(data, 2, growth)
        predicted = trees.forest_mean(found)
        assert found.feature[0].tolist() == found.feature[1].tolist()
    else:
        model, = trees.boost(data, [Model(growth, 1, 1.0)])
        predicted = trees.boosted_sum(model)
    dense = np.array([[np.searchsorted(data.cuts[data.first[f]:data.first[f + 1]], v) + data.first[f]
                       for f, v in enumerate(row)] for row in x])
    assert predicted(dense) == pytest.approx([centre + hand_predicted(wanted, row) for row in x])


def test_spark_models_predict_what_the_trees_do(spark, sample):
    df, x, y, n, fold = sample
    data = trees.binned(df, "fold", "_sum", "_squares")
    found, = trees.forest(data, 5, Growth(4, least_split=30))
    boosted, = trees.boost(data, [Model(Growth(3, l2=1.0, records=0.8, columns=0.7), 30, 0.2)])
    dense = np.array([[np.searchsorted(data.cuts[data.first[f]:data.first[f + 1]], v) + data.first[f]
                       for f, v in enumerate(row)] for row in x])
    for model, predicted in ((trees.forest_model(spark, found, data), trees.forest_mean(found)),
                             (trees.boosted_model(spark, boosted, data), trees.boosted_sum(boosted))):
        got = [r.prediction for r in model.transform(df.select("features")).collect()]
        assert sorted(got) == pytest.approx(sorted(predicted(dense)))
    # More trees than fit between two writings of the predictions, and better than none.
    spread = np.average((y - np.average(y, weights=n))**2, weights=n)
    assert np.average((y - trees.boosted_sum(boosted)(dense))**2, weights=n) < 0.2 * spread
    path = session.scratch_path(spark, "forest")
    trees.forest_model(spark, found, data).write().save(path)
    assert RandomForestRegressionModel.load(path).getNumTrees == 5


def test_models_side_by_side_are_those_grown_alone(sample):
    df, x, y, n, fold = sample
    data = trees.binned(df, "fold", "_sum", "_squares")
    growth = Growth(3, l2=1.0, records=0.5, columns=0.6)
    both = trees.boost(data, [Model(growth, 3, 0.3, 0), Model(Growth(2, l2=1.0, records=1.0), 5, 0.3, 1)])
    alone, = trees.boost(data, [Model(growth, 3, 0.3, 0)])
    for a, b in zip(both[0].grown, alone.grown):
        assert a.feature.tolist() == b.feature.tolist() and a.value == pytest.approx(b.value)
    assert [len(m.grown) for m in both] == [3, 5]
    part = df.where("fold <> 1")
    without, = trees.boost(trees.binned(part), [Model(Growth(2, l2=1.0, records=1.0), 5, 0.3)])
    assert both[1].start == pytest.approx(without.start)
    scores = trees.held_out_r2(data, [(m.fold, trees.boosted_sum(m)) for m in both])
    own = fold == 1
    dense = np.array([[np.searchsorted(data.cuts[data.first[f]:data.first[f + 1]], v) + data.first[f]
                       for f, v in enumerate(row)] for row in x])[own]
    error = (n[own] * (y[own] - trees.boosted_sum(both[1])(dense))**2).sum()
    total = (n[own] * (y[own] - np.average(y[own], weights=n[own]))**2).sum()
    assert scores[1] == pytest.approx(1 - error / total)


def test_bootstrap_draws_have_the_same_distribution_at_every_count():
    keys = np.arange(400) * 7919
    for count in (1.0, 20.0, 5_000.0, 1e8):
        got = trees.drawn(keys, np.full(400, count), list(range(100)), Growth(3, seed=1))
        assert got.mean() == pytest.approx(count, abs=5 * (count / got.size) ** 0.5)
        assert got.var() == pytest.approx(count, rel=0.05)
        # Draws of trees and of cells do not go together.
        assert abs(np.corrcoef(got[:, 0], got[:, 1])[0, 1]) < 0.2 and abs(np.corrcoef(got[0], got[1])[0, 1]) < 0.4
        again = trees.drawn(keys[::-1], np.full(400, count), list(range(100)), Growth(3, seed=1))
        assert (again[::-1] == got).all()
    some = trees.drawn(keys, np.full(400, 50.0), [3], Growth(3, records=0.8))
    assert some.max() <= 50 and some.mean() == pytest.approx(40, abs=1)


def test_bins_keep_values_apart_and_bound_their_number(spark):
    x = np.zeros((600, 2))
    x[:, 0], x[:, 1] = np.arange(600) % 250, np.arange(600) * 0.5
    data = trees.binned(frame(spark, x, np.zeros(600), np.ones(600)))
    assert data.first[1] == 250 and data.bins - 250 <= trees.BINS + 2
    assert (np.diff(data.cuts[250:-1]) > 0).all()


def test_empty_and_equal_cells(spark, sample):
    none = trees.binned(sample[0].where("false"))
    model, = trees.boost(none, [Model(Growth(3, l2=1.0, records=1.0), 2, 0.3)])
    assert model.start == 0.0 and trees.forest(none, 2, Growth(3))[0].feature.max() == -1
    same = trees.binned(frame(spark, np.ones((9, 2)), np.full(9, 4.0), np.ones(9)))
    found, = trees.forest(same, 3, Growth(3))
    assert found.feature.max() == -1 and found.value[:, 0] == pytest.approx([4.0] * 3)
    assert same.table.select(F.size("at")).first()[0] == 2
