"""Penalised least squares from sums of products, against the definitions on single records."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from stipendia.ml import penalty, tuning


@pytest.fixture(scope="module")
def sample(spark):
    """Weighted cells in three folds, sparse and dense vectors, one column without entries."""
    rng = np.random.default_rng(8)
    n, rows = 240, []
    x = np.zeros((n, 9))
    x[np.arange(n), rng.integers(0, 4, n)] = 1
    x[:, 4:8] = rng.normal(0, 1, (n, 4)) @ rng.normal(0, 1, (4, 4))
    y = x @ np.array([1, -1, .5, 0, .3, 0, 0, -.2, 0]) + 11 + rng.normal(0, .2, n)
    count, fold = rng.integers(1, 6, n).astype(float), rng.integers(0, 3, n)
    noise = rng.random(n) * .01
    for i in range(n):
        some = np.flatnonzero(x[i])
        vector = Vectors.sparse(9, some.tolist(), x[i, some].tolist()) if i % 3 else Vectors.dense(x[i])
        rows.append((int(fold[i]), vector, float(count[i]), float(y[i]), float(count[i] * y[i]),
                     float(count[i] * (y[i] ** 2 + noise[i]))))
    df = spark.createDataFrame(rows, ["fold", "features", "_count", "_mean", "_sum", "_squares"])
    return df, x, y, count, fold, noise


def objective(x, y, count, w, b, l1, l2):
    return (count * (y - x @ w - b) ** 2).sum() / 2 + l1 * np.abs(w).sum() + l2 * (w @ w) / 2


def test_sums_of_products(sample):
    df, x, y, count, fold, noise = sample
    sums = penalty.products(df, 3)
    matrix = np.zeros((9, 9))
    for r in sums.table.collect():
        matrix[r.i, r.j] = r.whole
        assert r.whole == pytest.approx(r.fold_0 + r.fold_1 + r.fold_2)
    assert matrix == pytest.approx(x.T @ (count[:, None] * x))
    for part in range(3):
        rest = fold != part
        feature, target, rows, total = sums.training(part)
        assert feature == pytest.approx(count[rest] @ x[rest])
        assert target == pytest.approx((count * y)[rest] @ x[rest])
        assert (rows, total) == pytest.approx((count[rest].sum(), (count * y)[rest].sum()))
    assert sums.squares[0] == pytest.approx((count * (y * y + noise)).sum())


@pytest.mark.parametrize("kind", ["linear", "ridge", "lasso", "elasticnet"])
def test_no_small_move_lowers_the_penalised_sum(sample, kind):
    df, x, y, count, fold, _ = sample
    sums = penalty.products(df, 3)
    grid = [0.0] if kind == "linear" else [0.003, 0.1, 3.0]
    found = penalty.fit(sums, {kind: grid})[kind]
    rng = np.random.default_rng(1)
    for part in range(3):
        rest = fold != part
        for at, alpha in enumerate(grid):
            w, b = found.weights[part, at], found.intercepts[part, at]
            l1, l2 = penalty.penalties(kind, alpha, count[rest].sum())
            args = x[rest], y[rest], count[rest]
            least = objective(*args, w, b, l1, l2)
            assert w[8] == 0
            for _ in range(60):
                move = rng.normal(0, 1, 10) * rng.choice([1e-1, 1e-3, 1e-5]) * (rng.random(10) < .4)
                assert objective(*args, w + move[:9], b + move[9], l1, l2) >= least - 1e-9 * abs(least)


def test_agrees_with_an_iterating_solver_on_all_folds(sample):
    df, x, _, count, fold, _ = sample
    sums = penalty.products(df, 3)
    found = penalty.fit(sums, {"lasso": [0.01]})["lasso"]
    df = df.coalesce(1).cache()
    for part in range(3):
        for at, alpha in enumerate(found.alphas):
            other = LinearRegression(
                solver="l-bfgs", standardization=False, maxIter=1000, tol=1e-14, regParam=alpha, elasticNetParam=1.0,
                labelCol="_mean", weightCol="_count").fit(df.where(F.col("fold") != part))
            # Groups of all levels have many best coefficients, but the same predictions.
            assert x @ found.weights[part, at] + found.intercepts[part, at] == pytest.approx(
                x @ other.coefficients.toArray() + other.intercept, abs=1e-6)


def test_errors_on_a_fold_come_from_its_sums(sample):
    df, x, y, count, fold, noise = sample
    sums = penalty.products(df, 3)
    found = penalty.fit(sums, {"ridge": [0.1, 50.0], "lasso": [0.02]})
    r2 = penalty.held_out_r2(sums, found)
    for kind, models in found.items():
        for part in range(3):
            own = fold == part
            mean = np.average(y[own], weights=count[own])
            spread = (count[own] * ((y[own] - mean) ** 2 + noise[own])).sum()
            for at in range(len(models.alphas)):
                left = y[own] - x[own] @ models.weights[part, at] - models.intercepts[part, at]
                assert r2[kind][part, at] == pytest.approx(1 - (count[own] * (left**2 + noise[own])).sum() / spread)


def test_tiles_lead_to_the_same_models(sample, monkeypatch):
    monkeypatch.setattr(penalty, "SETTLED", 1e-5)
    df, x = sample[:2]
    grids = {"ridge": [20.0], "lasso": [0.01, 0.1]}
    one, many = (penalty.products(df, 3, tile=size) for size in (2048, 5))
    whole, parts = penalty.fit(one, grids, [1]), penalty.fit(many, grids, [1])
    a, b = penalty.held_out_r2(one, whole), penalty.held_out_r2(many, parts)
    for kind in grids:
        for found in (whole[kind], parts[kind]):
            assert found.weights.shape == (1, len(grids[kind]), 9)
        assert parts[kind].weights @ x.T + parts[kind].intercepts[:, :, None] == pytest.approx(
            whole[kind].weights @ x.T + whole[kind].intercepts[:, :, None], abs=1e-3)
        assert b[kind] == pytest.approx(a[kind], abs=1e-5)


def test_equal_columns_and_folds_without_records(spark, sample):
    df, x, y, count, fold, _ = sample
    twice = df.where("fold < 2")
    sums = penalty.products(twice, 3)
    scores = penalty.held_out_r2(sums, penalty.fit(sums, {"ridge": [1.0]}))["ridge"][:, 0]
    assert np.isnan(scores[2]) and (scores[:2] > 0.5).all()
    none = penalty.products(df.where("false"), 3)
    assert none.width == 0 and penalty.fit(none, {"lasso": [1.0]})["lasso"].weights.shape == (3, 1, 0)
    same = spark.createDataFrame([(0, Vectors.dense([v, v, 2 * v]), 1.0, 3 * v, 3 * v, 9 * v * v)
                                  for v in (0.0, 1.0, 2.0, 5.0)], df.schema)
    fit = penalty.fit(penalty.products(same), {"linear": [0.0], "lasso": [1e-4]}, [-1])
    # Of all solutions the shortest, and with an absolute penalty the one that uses the larger column.
    assert fit["linear"].weights[0, 0] == pytest.approx([0.5, 0.5, 1.0])
    assert fit["lasso"].weights[0, 0][:2] == pytest.approx([0, 0], abs=1e-6)


def test_search_and_validation_use_them(sample):
    df = sample[0]
    best = tuning.tune_alphas(df, 3, ["ridge", "lasso", "elasticnet"])
    for kind, found in best.items():
        assert found["best_alpha"] in tuning.alphas(kind) and found["best_cv_r2"] > 0.8
        again, = tuning.cross_validate(df, 3, {kind: found["best_alpha"]})
        assert again["mean_r2"] == pytest.approx(found["best_cv_r2"])
