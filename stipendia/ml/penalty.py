"""Least squares with penalties, from sums of products that add up over folds.

One aggregation of the cells gives, for each pair of features and each fold, the weighted sum of their
products. The sums of a training part are those of all records less those of its fold, and so are the
errors on the fold itself, so no candidate and no fold reads the cells again.

The sums are a table in tiles of TILE rows of the matrix. A task holds the square of one tile (2048: 32 MB, and
a copy with the means taken out) for one fold and one kind of model, and goes down all its penalties
with warm starts. Up to TILE features there is one tile, and its solution is final. For wider inputs tiles are solved one
after another, with what the coefficients of the others explain taken off first, until no coefficient
moves; the rest of the matrix is only read row by row. The driver holds coefficients, never the matrix.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipendia import session
from stipendia.ml.cells import COUNT, MEAN, SQUARES
from stipendia.ml.preprocess import FEATURES

TILE = 2048
#: Passes over all tiles, and the move of the predictions (root mean square, as a share of the target's deviation)
#: that a pass may make at most to be the last one.
PASSES, SETTLED = 200, 1e-6
#: Distance from the conditions of a least value, as a share of the largest product with the target.
EXACT = 1e-11
SWEEPS = 10_000
#: Numbers of the constant and of the target among the features.
ONE, LABEL = -1, -2
#: Share of the absolute penalty.
L1_SHARE = {"linear": 0.0, "ridge": 0.0, "lasso": 1.0, "elasticnet": 0.5}


def penalties(kind: str, alpha: float, rows: float) -> tuple[float, float]:
    """Absolute and squared penalty beside half the sum of squares.

    Ridge adds alpha * |w|^2 to the sum of squares; lasso and elastic net add their penalty to half
    the mean of squares.
    """
    if kind == "ridge":
        return 0.0, alpha
    share = L1_SHARE[kind]
    return rows * alpha * share, rows * alpha * (1 - share) if kind != "linear" else 0.0


@dataclass
class Products:
    """The table of sums of products (tile, i, j, whole, fold_0, ...) and the sums beside it.

    `feature` and `target` hold, for all records and each fold, the sums of each feature and of its products with the
    target; `rows`, `total` and `squares` those of the records, their targets and squared targets.
    """

    table: DataFrame
    folds: int
    tile: int
    feature: np.ndarray
    target: np.ndarray
    rows: np.ndarray
    total: np.ndarray
    squares: np.ndarray

    @property
    def width(self) -> int:
        return self.feature.shape[1]

    def training(self, part: int) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Sums of features, of products with the target, of records and targets without a fold.

        A negative part is all records.
        """
        values = (self.feature, self.target, self.rows, self.total)
        return tuple(v[0] if part < 0 else v[0] - v[part + 1] for v in values)


def products(data: DataFrame, folds: int = 0, fold: str = "fold", tile: int = TILE) -> Products:
    """The sums of transformed cells, in one pass; `fold` numbers their folds from 0."""
    vector = F.unwrap_udt(FEATURES)
    places = F.coalesce(vector["indices"], F.sequence(F.lit(0), F.size(vector["values"]) - 1))
    pairs = F.zip_with(places, vector["values"], lambda i, v: F.struct(i.alias("i"), v.alias("v")))
    some = F.filter(pairs, lambda e: e["v"] != 0)
    ends = F.array(F.struct(F.lit(LABEL).alias("i"), F.col(MEAN).alias("v")),
                   F.struct(F.lit(ONE).alias("i"), F.lit(1.0).alias("v")))
    kept = [fold] if folds else []
    listed = data.select(*kept, COUNT, SQUARES, F.concat(ends, some).alias("e"))
    one = listed.select(*kept, COUNT, SQUARES, "e", F.explode("e").alias("a"))
    both = one.select(*kept, COUNT, SQUARES, "a", F.explode(F.filter(
        "e", lambda b: b["i"] >= F.col("a.i"))).alias("b"))
    # Cells know the sum of their squares; all other products are those of equal rows.
    value = F.when((F.col("a.i") == LABEL) & (F.col("b.i") == LABEL), F.col(SQUARES)).otherwise(
        F.col(COUNT) * F.col("a.v") * F.col("b.v"))
    found = both.select(*kept, F.col("a.i").alias("i"), F.col("b.i").alias("j"), value.alias("v"))
    sums = found.groupBy("i", "j").agg(F.sum("v").alias("whole"), *[
        F.sum(F.when(F.col(fold) == f, F.col("v")).otherwise(0.0)).alias(f"fold_{f}") for f in range(folds)])
    names = ["whole", *(f"fold_{f}" for f in range(folds))]
    upper = session.written(sums, "products")
    table = session.written(upper.where("i >= 0").unionByName(upper.where("i >= 0 and j > i").select(
        F.col("j").alias("i"), F.col("i").alias("j"), *names)).withColumn(
            "tile", F.floor(F.col("i") / tile).cast("int")), "tiles")

    size = F.coalesce(vector["size"], F.size(vector["values"]))
    width = data.agg(F.coalesce(F.max(size), F.lit(0))).first()[0]
    edge = upper.where("i < 0").collect()
    feature, target = np.zeros((folds + 1, width)), np.zeros((folds + 1, width))
    scalars = {(a, b): np.zeros(folds + 1) for a, b in ((LABEL, LABEL), (LABEL, ONE), (ONE, ONE))}
    for row in edge:
        values = np.array([row[n] for n in names])
        if row.j < 0:
            scalars[(row.i, row.j)] = values
        else:
            (feature if row.i == ONE else target)[:, row.j] = values
    return Products(table, folds, tile, feature, target, scalars[(ONE, ONE)], scalars[(LABEL, ONE)],
                    scalars[(LABEL, LABEL)])


def direction(square: np.ndarray, aim: np.ndarray) -> tuple[np.ndarray, float]:
    """The step to a solution of a linear system, and how far to go along it at most.

    Where there is none, a direction in which the value falls evenly: it has no end of its own.
    """
    try:
        step = np.linalg.solve(square, aim)
        if np.abs(square @ step - aim).max() <= 1e-9 * np.abs(aim).max():
            return step, 1.0
    except np.linalg.LinAlgError:
        pass
    values, vectors = np.linalg.eigh(square)
    flat = values <= values[-1] * len(aim) * np.finfo(float).eps * 16
    along = vectors.T @ aim
    fall = vectors[:, flat] @ along[flat]
    if np.abs(fall).max(initial=0.0) > 1e-9 * np.abs(aim).max():
        return fall, np.inf
    return vectors[:, ~flat] @ (along[~flat] / values[~flat]), 1.0


def least(matrix: np.ndarray, aim: np.ndarray, l1: float, l2: float, start: np.ndarray) -> np.ndarray:
    """The w of the least w'Gw/2 - r'w + l1 |w| + l2 w'w/2, from a first guess.

    Without an absolute penalty that is a linear system; where it has several solutions, the one nearest to
    the guess. Otherwise coordinates are set one by one, and the signs found are tried in a linear
    system of the coefficients that are not zero; a step towards its solution stops where a sign would change.
    """
    size = len(aim)
    if not size:
        return start
    if l1 == 0:
        left = aim - matrix @ start - l2 * start
        if l2 > 0:
            return start + np.linalg.solve(matrix + l2 * np.eye(size), left)
        values, vectors = np.linalg.eigh(matrix)
        kept = values > values[-1] * size * np.finfo(float).eps * 16
        return start + vectors[:, kept] @ ((vectors[:, kept].T @ left) / values[kept])
    w, diagonal = start.copy(), matrix.diagonal() + l2
    usable = np.flatnonzero(matrix.diagonal() > 1e-12 * max(matrix.diagonal().max(), 1e-300))
    w[np.setdiff1d(np.arange(size), usable)] = 0
    gradient = aim - matrix @ w
    limit = EXACT * max(np.abs(aim).max(), l1)

    def sweep(places: np.ndarray) -> None:
        nonlocal gradient
        for j in places.tolist():
            rho = gradient[j] + matrix[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / diagonal[j]
            if new != w[j]:
                gradient -= matrix[:, j] * (new - w[j])
                w[j] = new

    for _ in range(SWEEPS):
        sweep(usable)
        for _ in range(size):
            some = np.flatnonzero(w)
            if not len(some):
                break
            square = matrix[np.ix_(some, some)] + l2 * np.eye(len(some))
            step, most = direction(square, gradient[some] - l2 * w[some] - l1 * np.sign(w[some]))
            reach = np.full(len(some), np.inf)
            shrinks = w[some] * step < 0
            reach[shrinks] = -w[some][shrinks] / step[shrinks]
            share = min(most, reach.min())
            if not np.isfinite(share):
                break
            w[some] += share * step
            w[some[reach <= share]] = 0
            gradient = aim - matrix @ w
            if share == 1.0 and most == 1.0:
                break
        slope = gradient - l2 * w
        off = np.where(w != 0, np.abs(slope - l1 * np.sign(w)), np.maximum(np.abs(slope) - l1, 0.0))
        if off[usable].max(initial=0.0) <= limit:
            break
    return w


class Fit(NamedTuple):
    """Coefficients and intercepts: a row for each training part, a column for each penalty."""

    parts: list[int]
    alphas: list[float]
    weights: np.ndarray
    intercepts: np.ndarray


SOLVED = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("moved", pa.float64()),
                    ("w", pa.list_(pa.float64()))])


def tile_solver(low: int, high: int, sums: dict, grids: dict[str, list[float]], found: dict, first: bool):
    """The task that finds the coefficients from `low` to `high` of one kind and training part, all others
    being as found before."""
    def rows(entries: pa.Table) -> pa.Table:
        kind, part = entries.column("kind")[0].as_py(), entries.column("part")[0].as_py()
        i, j, v = (entries.column(c).to_numpy() for c in ("i", "j", "v"))
        feature, target, count, total = sums[part]
        inside = (j >= low) & (j < high)
        matrix = np.zeros((high - low, high - low))
        matrix[i[inside] - low, j[inside] - low] = v[inside]
        own = feature[low:high]
        matrix -= np.outer(own, own) / count
        aim = target[low:high] - own * (total / count)
        i, j, v = i[~inside] - low, j[~inside], v[~inside]
        weights, before, moved = found[(kind, part)].copy(), None, 0.0
        # From the largest penalty down, each starts where the one before ended.
        for at in sorted(range(len(grids[kind])), key=lambda a: -grids[kind][a]):
            others = weights[at].copy()
            others[low:high] = 0
            taken = np.bincount(i, weights=v * others[j], minlength=high - low) - own * (
                feature @ others / count)
            start = before if first and before is not None else weights[at, low:high]
            before = least(matrix, aim - taken, *penalties(kind, grids[kind][at], count), start)
            step = before - weights[at, low:high]
            moved = max(moved, step @ matrix @ step / count)
            weights[at, low:high] = before
        return pa.table({"kind": [kind], "part": [part], "moved": [moved],
                         "w": [weights[:, low:high].ravel().tolist()]}, schema=SOLVED)

    return rows


def fit(data: Products, grids: dict[str, list[float]], parts: list[int] | None = None) -> dict[str, Fit]:
    """Models of some kinds for their penalties: without each fold in turn, or (part -1) on all records."""
    parts = (list(range(data.folds)) or [-1]) if parts is None else parts
    sums = {part: data.training(part) for part in parts}
    full = [part for part in parts if sums[part][2] > 0]
    found = {(kind, part): np.zeros((len(grid), data.width)) for kind, grid in grids.items() for part in parts}
    without = {part: F.col(f"fold_{part}") if part >= 0 else F.lit(0.0) for part in full}
    groups = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(part).alias("part"), (F.col("whole") - without[part]).alias("v"))
        for kind in grids for part in full])).alias("g") if full else None
    tiles = range(0, data.width if full else 0, data.tile)
    spread = (data.squares[0] - data.total[0] ** 2 / data.rows[0]) / data.rows[0] if full else 0.0
    for turn in range(PASSES if len(tiles) > 1 else 1):
        moved = 0.0
        for low in tiles:
            high = min(low + data.tile, data.width)
            entries = data.table.where(F.col("tile") == low // data.tile).select("i", "j", groups)
            solved_rows = entries.select("i", "j", "g.*").groupBy("kind", "part").applyInArrow(
                tile_solver(low, high, sums, grids, dict(found), turn == 0),
                "kind string, part int, moved double, w array<double>").collect()
            for row in solved_rows:
                old = found[(row.kind, row.part)]
                old[:, low:high] = np.array(row.w).reshape(len(old), -1)
                moved = max(moved, row.moved)
        if moved <= SETTLED ** 2 * spread:
            break
    out = {}
    for kind, grid in grids.items():
        weights = np.stack([found[(kind, part)] for part in parts])
        centre = [(sums[part][3] - w @ sums[part][0]) / sums[part][2] if part in full else np.zeros(len(grid))
                  for part, w in zip(parts, weights)]
        out[kind] = Fit(parts, grid, weights, np.array(centre))
    return out


def held_out_r2(data: Products, models: dict[str, Fit]) -> dict[str, np.ndarray]:
    """r2 of each model on the fold it was fitted without: a row for each fold, a column for each penalty."""
    weights = {(kind, part): fit.weights[at] for kind, fit in models.items() for at, part in enumerate(fit.parts)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {key: np.zeros(len(w)) for key, w in weights.items()}
        for batch in batches:
            i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
            for (kind, part), w in weights.items():
                v = batch.column(f"fold_{part}").to_numpy()
                sums[(kind, part)] += np.einsum("an,an,n->a", w[:, i], w[:, j], v)
        yield pa.RecordBatch.from_pylist([
            {"kind": kind, "part": part, "at": at, "v": float(x)}
            for (kind, part), found in sums.items() for at, x in enumerate(found)], pa.schema(
                [("kind", pa.string()), ("part", pa.int32()), ("at", pa.int32()), ("v", pa.float64())]))

    parts = sorted({part for fit in models.values() for part in fit.parts})
    columns = ["i", "j", *(f"fold_{part}" for part in parts)]
    squares = {key: np.zeros(len(w)) for key, w in weights.items()}
    for row in data.table.select(*columns).mapInArrow(
            rows, "kind string, part int, at int, v double").groupBy("kind", "part", "at").agg(
            F.sum("v").alias("v")).collect():
        squares[(row.kind, row.part)][row.at] = row.v
    out = {}
    for kind, fit in models.items():
        scores = np.full(fit.intercepts.shape, np.nan)
        for at, part in enumerate(fit.parts):
            own = part + 1
            w, c, n, total = fit.weights[at], fit.intercepts[at], data.rows[own], data.total[own]
            if not n:
                continue
            error = (data.squares[own] - 2 * (w @ data.target[own] + c * total) + squares[(kind, part)]
                     + 2 * c * (w @ data.feature[own]) + n * c * c)
            spread = data.squares[own] - total * total / n
            scores[at] = 1 - error / spread if spread > 0 else np.nan
        out[kind] = scores
    return out


def model(spark: SparkSession, weights: np.ndarray, intercept: float) -> LinearRegressionModel:
    """A linear model with these coefficients, for pipelines and for saving."""
    java = spark._jvm.org.apache.spark.ml.regression.LinearRegressionModel(
        f"penalty_{uuid.uuid4().hex[:12]}", _py2java(spark.sparkContext, Vectors.dense(weights)), float(intercept))
    found = LinearRegressionModel(java)
    return found.setFeaturesCol(FEATURES)
