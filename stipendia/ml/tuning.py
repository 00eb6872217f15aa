"""Grid search, random search and cross-validation on cells."""

from __future__ import annotations

import itertools
import random
from statistics import fmean, pstdev

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipendia.ml import models, penalty, trees
from stipendia.ml.cells import SQUARES, SUM, TARGET
from stipendia.operators.folds import contiguous_folds, group_folds

# Exponents of the alpha grids, and the space of boosted trees.
ALPHA_EXPONENTS = {"ridge": (-3, 3), "lasso": (-5, 1), "elasticnet": (-4, 1)}
ALPHA_POINTS = 10
BOOSTING_SPACE = {
    "maxIter": [100, 200], "stepSize": [0.05, 0.1], "maxDepth": [3, 5],
    "subsamplingRate": [0.8, 1.0],
}
DRAWS = 4


def alphas(kind: str) -> list[float]:
    low, high = ALPHA_EXPONENTS[kind]
    return [10 ** (low + i * (high - low) / (ALPHA_POINTS - 1)) for i in range(ALPHA_POINTS)]


def draws(seed: int = 42, count: int = DRAWS) -> list[dict]:
    """Distinct random points of the space of boosted trees."""
    points = [dict(zip(BOOSTING_SPACE, p)) for p in itertools.product(*BOOSTING_SPACE.values())]
    return random.Random(seed).sample(points, min(count, len(points)))


def folded_cells(setup: models.Setup, df: DataFrame, k: int) -> DataFrame:
    return setup.cells(contiguous_folds(df, k, keep=[*setup.categorical, *setup.numeric, TARGET]), "fold")


def group_folded_cells(setup: models.Setup, df: DataFrame, k: int, *group: str) -> DataFrame:
    """Folds that keep all records of a group together."""
    return setup.cells(group_folds(df, k, [F.col(g) for g in group]), "fold")


def tune_alphas(folded: DataFrame, k: int, kinds: list[str]) -> dict[str, dict[str, float]]:
    """For each kind the penalty with the best mean r2 over the folds, all from one pass over the cells.

    Refit with models.train_model.
    """
    sums = penalty.products(folded, k)
    scores = penalty.held_out_r2(sums, found := penalty.fit(sums, {kind: alphas(kind) for kind in kinds}))
    out = {}
    for kind in kinds:
        means = scores[kind].mean(axis=0).tolist()
        best = max(range(len(means)), key=means.__getitem__)
        out[kind] = {"best_alpha": found[kind].alphas[best], "best_cv_r2": means[best]}
    return out


def tune_boosting(folded: DataFrame, k: int, points: list[dict] | None = None) -> dict:
    """The point with the best mean r2; the models of all points and folds grow side by side."""
    points = draws() if points is None else points
    data = trees.binned(folded, "fold", SUM, SQUARES)
    grown = trees.boost(data, [models.boosting(fold, **p) for p in points for fold in range(k)])
    flat = trees.held_out_r2(data, [(m.fold, trees.boosted_sum(m)) for m in grown])
    means = [fmean(flat[i * k:(i + 1) * k]) for i in range(len(points))]
    best = max(range(len(points)), key=means.__getitem__)
    return {**points[best], "best_cv_r2": means[best]}


def _tree_scores(kind: str, data: trees.Binned, k: int) -> list[float]:
    """r2 on each fold of a forest or boosted model grown on the others."""
    folds = list(range(k))
    if kind == "rf":
        grown = trees.forest(data, models.FOREST["numTrees"], models.forest_growth(), folds)
        return trees.held_out_r2(data, [(f, trees.forest_mean(t)) for f, t in zip(folds, grown)])
    found = trees.boost(data, [models.boosting(f) for f in folds])
    return trees.held_out_r2(data, [(m.fold, trees.boosted_sum(m)) for m in found])


def cross_validate(folded: DataFrame, k: int, kinds: dict[str, float | None]) -> list[dict]:
    """Refit on the folds of the given table, with the default penalty for None; mean and population
    deviation of r2."""
    chosen = {kind: [models.DEFAULT_ALPHA[kind] if alpha is None else alpha] for kind, alpha in kinds.items()
              if kind in models.DEFAULT_ALPHA}
    scores = {}
    if chosen:
        sums = penalty.products(folded, k)
        scores = {kind: r2[:, 0].tolist() for kind, r2 in penalty.held_out_r2(
            sums, penalty.fit(sums, chosen)).items()}
    if len(chosen) < len(kinds):
        data = trees.binned(folded, "fold", SUM, SQUARES)
        scores.update({kind: _tree_scores(kind, data, k) for kind in kinds if kind not in chosen})
    return [{"model": kind, "mean_r2": fmean(scores[kind]), "std_r2": pstdev(scores[kind])} for kind in kinds]
