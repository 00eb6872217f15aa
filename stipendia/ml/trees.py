"""Regression trees on counted cells: forests with a bootstrap of records, and second-order boosting.

Trees grow level by level, all trees of a batch together. Tasks send the weight and the weighted target of
each (node, bin) of their cells, combined before the shuffle; whoever gets a node's bins finds its
best split, and one row a node comes back. What the driver holds is the model.

The bootstrap draws for each cell and tree a Poisson number with the cell's count as mean, from a
generator seeded by the cell's inputs, so draws depend neither on partitions nor on the size of the table,
and a cell of a million records is drawn about a million times, as its records would be.
Boosting fits each tree to the gradient of the squared error with the count as second derivative; the weights of leaves
are shrunk by an L2 term, and a split must gain more than a least gain.

Values of an input are cut at 256 bins at most, at quantiles of its different values, so up to 256 different
values are kept apart.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipendia import session
from stipendia.ml.cells import COUNT, MEAN, SQUARES, SUM
from stipendia.ml.preprocess import FEATURES

BINS = 256
#: Pairs of cell and tree that a task works on, at least; and at a time.
TASK_PAIRS, SLICE_PAIRS = 60_000, 200_000
#: Bins, by cell and input, that a task lays out at a time.
SLICE_CELLS = 4_000_000
#: Groups in which nodes look for their splits.
GROUPS = 32
#: Trees of a boosted model between two writings of the predictions so far.
WRITE_EVERY = 25


@dataclass
class Binned:
    """Cells with the bins of their inputs: _key, _count, _mean, kept columns, and `at`, the bins of all
    entries that are set.

    The bins of input f are numbered from first[f] to first[f + 1] - 1; `cuts` has the upper bounds of all bins
    (the last one of each input has none), `zero` the bin of an entry that is not set.
    """

    table: DataFrame
    first: np.ndarray
    cuts: np.ndarray
    zero: np.ndarray
    cells: int

    @property
    def bins(self) -> int:
        return int(self.first[-1])


def entries(data: DataFrame, *keep: str) -> tuple[DataFrame, int]:
    """Transformed cells with the numbers and values of the set entries, and the width of the vector."""
    vector = F.unwrap_udt(FEATURES)
    places = F.coalesce(vector["indices"], F.sequence(F.lit(0), F.size(vector["values"]) - 1))
    pairs = F.filter(F.zip_with(places, vector["values"], lambda i, v: F.struct(i.alias("i"), v.alias("v"))),
                     lambda e: e["v"] != 0)
    size = F.coalesce(vector["size"], F.size(vector["values"]))
    width = data.agg(F.coalesce(F.max(size), F.lit(0))).first()[0]
    # What tells cells apart also seeds their draws.
    return data.withColumns({"_set": pairs, "_key": F.xxhash64(pairs, COUNT, *keep)}), width


def binned(data: DataFrame, *keep: str) -> Binned:
    """Cells cut into bins, in the shared folder."""
    ready, width = entries(data, *keep)
    total = ready.count()
    values = ready.select(F.explode("_set").alias("e")).groupBy("e.i", "e.v").count()
    shares = [k / BINS for k in range(BINS + 1)]
    spread = values.groupBy("i").agg(
        F.sum("count").alias("n"), F.percentile_approx("v", F.lit(shares), 100 * BINS).alias("q")).collect()
    bounds = [np.zeros(0)] * width
    for row in spread:
        kept = np.unique([*row.q, 0.0] if row.n < total else row.q)
        bounds[row.i] = (kept[1:] + kept[:-1]) / 2
    first = np.concatenate([[0], np.cumsum([len(b) + 1 for b in bounds])]).astype(np.int64)
    cuts = np.concatenate([np.append(b, np.inf) for b in bounds]) if width else np.zeros(0)
    zero = first[:-1] + np.array([np.searchsorted(b, 0.0) for b in bounds], np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(batch.schema.get_field_index("_set"))
            flat = listed.flatten()
            i, v = flat.field("i").to_numpy(), flat.field("v").to_numpy()
            # Bins of one input ascend, so the number of its bounds below a value is its bin.
            order = np.lexsort((v, i))
            at = np.empty(len(i), np.int32)
            begin = np.searchsorted(i[order], np.arange(width + 1))
            for f in np.unique(i).tolist():
                some = order[begin[f]:begin[f + 1]]
                at[some] = first[f] + np.searchsorted(bounds[f], v[some])
            offsets = listed.offsets.to_numpy()
            out = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [*(c for c, n in zip(batch.columns, batch.schema.names) if n != "_set"), out],
                names=[*(n for n in batch.schema.names if n != "_set"), "at"])

    kept = [*keep, "_key", COUNT, MEAN]
    chosen = ready.select(*kept, "_set")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    table = session.written(chosen.mapInArrow(rows, f"{schema}, at array<int>"), "binned")
    return Binned(table, first, cuts, zero, total)


@dataclass
class Trees:
    """Trees in flat arrays, a row a tree and a column a node; node 0 is the root.

    A node with a `feature` of -1 is a leaf. Others send bins up to `bin` to node `left`, the rest to the one
    after it.
    """

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray
    weight: np.ndarray
    gain: np.ndarray

    @staticmethod
    def roots(count: int) -> Trees:
        def of(fill, kind):
            return np.full((count, 1), fill, kind)

        return Trees(of(-1, np.int32), of(0, np.int32), of(0, np.int32), of(0.0, float), of(0.0, float),
                     of(0.0, float))

    def widened(self, more: int) -> None:
        for name, fill in (("feature", -1), ("bin", 0), ("left", 0), ("value", 0.0), ("weight", 0.0), ("gain", 0.0)):
            old = getattr(self, name)
            setattr(self, name, np.concatenate(
                [old, np.full((len(old), more), fill, old.dtype)], axis=1))

    def leaves(self, dense: np.ndarray) -> np.ndarray:
        """The node where each cell (a row of bins by input) ends in each tree."""
        node = np.zeros((len(dense), len(self.feature)), np.int64)
        tree = np.arange(len(self.feature))
        row = np.arange(len(dense))[:, None]
        while True:
            feature = self.feature[tree, node]
            inner = feature >= 0
            if not inner.any():
                return node
            right = dense[row, np.maximum(feature, 0)] > self.bin[tree, node]
            node = np.where(inner, self.left[tree, node] + right, node)

    def predicted(self, dense: np.ndarray) -> np.ndarray:
        return self.value[np.arange(len(self.feature)), self.leaves(dense)]


@dataclass(frozen=True)
class Growth:
    """How trees grow. Weights are numbers of records."""

    depth: int
    least_split: float = 2.0
    least_leaf: float = 1.0
    l2: float = 0.0
    least_gain: float = 0.0
    #: Share of the inputs that a tree may use, and of the records it is grown on; None is a bootstrap.
    columns: float = 1.0
    records: float | None = None
    seed: int = 42


@dataclass
class Model:
    """A boosted model on its way: its settings, the fold left out, its start and trees."""

    growth: Growth
    trees: int
    step: float
    fold: int | None = None
    start: float = 0.0
    grown: list[Trees] = field(default_factory=list)


def uniform(*parts: np.ndarray | int) -> np.ndarray:
    """Numbers from 0 to 1 that follow from some whole numbers."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for part in parts:
            h = (h ^ np.asarray(part).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h = h * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
    return (h >> np.uint64(11)).astype(float) / 2**53


def drawn(keys: np.ndarray, counts: np.ndarray, trees: list[int], growth: Growth) -> np.ndarray:
    """How many records of each cell each tree gets."""
    if growth.records is not None and growth.records >= 1:
        return np.repeat(counts[:, None], len(trees), axis=1)
    out = np.empty((len(keys), len(trees)))
    for row, (key, n) in enumerate(zip(keys.astype(np.uint64).tolist(), counts.tolist())):
        block, size = trees[0], trees[-1] + 1
        numbers = np.random.Generator(np.random.Philox(key=[growth.seed, key], counter=[0, 0, 0, block]))
        chosen = numbers.poisson(n, size - block) if growth.records is None else \
            numbers.binomial(int(round(n)), growth.records, size - block)
        out[row] = chosen[np.array(trees) - block]
    return out


def sums(slots: np.ndarray, weight: np.ndarray, target: np.ndarray, at: np.ndarray, ends: np.ndarray,
         bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight and weighted target by slot * (bins + 1) + bin, of all cells and trees; the last bin of a slot
    is the whole node. `slots`, `weight` and `target` have a row a cell and a column a tree."""
    cell, tree = np.nonzero((slots >= 0) & (weight > 0))
    slot, w = slots[cell, tree], weight[cell, tree]
    g = w * target[cell, tree]
    begin = ends - np.diff(ends, prepend=0)
    size = (ends - begin)[cell]
    total = np.cumsum(size)
    place = np.repeat(begin[cell] - total + size, size) + np.arange(total[-1] if len(total) else 0)
    keys = np.concatenate([np.repeat(slot, size) * (bins + 1) + at[place], slot * (bins + 1) + bins])
    found, number = np.unique(keys, return_inverse=True)
    return (found, np.bincount(number, np.concatenate([np.repeat(w, size), w]), len(found)),
            np.bincount(number, np.concatenate([np.repeat(g, size), g]), len(found)))


def best_splits(keys: np.ndarray, h: np.ndarray, g: np.ndarray, first: np.ndarray, zero: np.ndarray,
                allowed, growth: Growth) -> dict[str, np.ndarray]:
    """The best split of each slot: input (-1: none), last bin to the left, gain, and sums of both sides."""
    bins = int(first[-1])
    slot, bin_ = keys // (bins + 1), keys % (bins + 1)
    whole = bin_ == bins
    order = np.argsort(slot[whole])
    slots, all_h, all_g = slot[whole][order], h[whole][order], g[whole][order]
    slot, bin_, h, g = slot[~whole], bin_[~whole], h[~whole], g[~whole]
    at = np.searchsorted(slots, slot)
    feature = np.searchsorted(first, bin_, side="right") - 1
    # What is not set in a node lies in the bin of zero.
    pair = at * len(zero) + feature
    pairs, number = np.unique(pair, return_inverse=True)
    rest_h = all_h[pairs // len(zero)] - np.bincount(number, h, len(pairs))
    rest_g = all_g[pairs // len(zero)] - np.bincount(number, g, len(pairs))
    some = rest_h > 1e-9 * all_h[pairs // len(zero)]
    places = np.concatenate([at * bins + bin_, (pairs // len(zero) * bins + zero[pairs % len(zero)])[some]])
    places, number = np.unique(places, return_inverse=True)
    h = np.bincount(number, np.concatenate([h, rest_h[some]]), len(places))
    g = np.bincount(number, np.concatenate([g, rest_g[some]]), len(places))
    at, bin_ = places // bins, places % bins
    feature = np.searchsorted(first, bin_, side="right") - 1
    begins = np.flatnonzero(np.diff(at * len(zero) + feature, prepend=-1))
    group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(at))))

    def left_of(values: np.ndarray) -> np.ndarray:
        total = np.cumsum(values)
        return total - (total - values)[begins][group]

    left_h, left_g = left_of(h), left_of(g)
    right_h, right_g = all_h[at] - left_h, all_g[at] - left_g
    last = np.append(np.diff(group) > 0, True)[:len(at)]
    good = ~last & (left_h >= growth.least_leaf) & (right_h >= growth.least_leaf) & (
        all_h[at] >= growth.least_split)
    good &= allowed(slots[at], feature)

    def score(g, h):
        return g * g / np.maximum(h + growth.l2, 1e-300)

    gain = np.where(good, (score(left_g, left_h) + score(right_g, right_h) - score(all_g[at], all_h[at])) / 2, -np.inf)
    # Gains that differ by rounding only are a tie, which the first input and bin win.
    best = np.full(len(slots), -np.inf)
    np.maximum.at(best, at, gain)
    close = np.flatnonzero(gain >= best[at] - 1e-12 * np.abs(best[at]))
    chosen = np.full(len(slots), -1, np.int64)
    chosen[at[close][::-1]] = close[::-1]
    usable = (chosen >= 0) & np.isfinite(best) & (best > growth.least_gain + 1e-12 * np.maximum(
        score(all_g, all_h), 1e-300))
    pick = np.maximum(chosen, 0)
    empty = np.zeros(len(slots))
    return {"slot": slots, "feature": np.where(usable, feature[pick] if len(feature) else -1, -1),
            "bin": np.where(usable, bin_[pick] if len(bin_) else 0, 0),
            "gain": np.where(usable, best, 0.0), "h": all_h, "g": all_g,
            "left_h": left_h[pick] if len(at) else empty, "left_g": left_g[pick] if len(at) else empty}


def leaf_value(g: float, h: float, growth: Growth) -> float:
    return g / (h + growth.l2) if h + growth.l2 > 0 else 0.0


SPLITS = pa.schema([("slot", pa.int64()), ("feature", pa.int64()), ("bin", pa.int64()), ("gain", pa.float64()),
                    ("h", pa.float64()), ("g", pa.float64()), ("left_h", pa.float64()), ("left_g", pa.float64())])


@dataclass
class Cells:
    """Some cells as arrays: the bins that are set, where each cell's end, and the bins of all inputs."""

    at: np.ndarray
    ends: np.ndarray
    dense: np.ndarray
    key: np.ndarray
    n: np.ndarray
    mean: np.ndarray
    fold: np.ndarray | None
    #: For each boosted model what it predicts so far, and the records of the next trees, a column a tree.
    margins: list[np.ndarray]
    draws: list[np.ndarray]

    @staticmethod
    def of(part: pa.RecordBatch, first: np.ndarray, zero: np.ndarray) -> Cells:
        listed = part.column(part.schema.get_field_index("at"))
        ends = listed.offsets.to_numpy().astype(np.int64)
        at, ends = listed.flatten().to_numpy().astype(np.int64), (ends - ends[0])[1:]
        dense = np.repeat(zero[None, :], part.num_rows, axis=0)
        dense[np.repeat(np.arange(part.num_rows), np.diff(ends, prepend=0)),
              np.searchsorted(first, at, side="right") - 1] = at
        names = part.schema.names
        margins = [part.column(n).to_numpy() for n in names if n.startswith("_margin_")]
        return Cells(at, ends, dense, *(part.column(c).to_numpy() for c in ("_key", COUNT, MEAN)),
                     part.column("fold").to_numpy() if "fold" in names else None, margins, [])

    def drawn(self, models: list[Model], first: int) -> Cells:
        """With the records that the next trees get."""
        turns = list(range(first, first + WRITE_EVERY))
        return replace(self, draws=[weights(self, [m], [turns]) for m in models])

    def advanced(self, models: list[Model], trees: list[Trees]) -> Cells:
        """With one more tree of each model in its prediction; none for a model that is finished."""
        return replace(self, margins=[
            margin + m.step * tree.predicted(self.dense)[:, 0] if len(tree.feature) else margin
            for margin, m, tree in zip(self.margins, models, trees)])


class Growing:
    """A batch of trees on their way, level by level."""

    def __init__(self, models: list[Model], batch: list[list[int]]) -> None:
        self.models, self.batch = models, batch
        self.owner = [m for m, numbers in enumerate(batch) for _ in numbers]
        self.numbers = np.array([n for b in batch for n in b])
        self.growth = models[0].growth
        self.trees = Trees.roots(len(self.owner))
        self.open = [(t, 0) for t in range(len(self.owner))]
        self.used = [1] * len(self.owner)

    def slots(self) -> np.ndarray:
        """The number of each node that may be split, by tree and node."""
        out = np.full(self.trees.feature.shape, -1, np.int64)
        for slot, (t, node) in enumerate(self.open):
            out[t, node] = slot
        return out

    def chooser(self):
        """Whether the tree of a slot may use an input."""
        tree_of = np.array([t for t, _ in self.open], np.int64)
        columns = np.array([self.models[m].growth.columns for m in self.owner])
        numbers, seed = self.numbers, self.growth.seed

        def allowed(slot: np.ndarray, feature: np.ndarray) -> np.ndarray:
            tree = tree_of[slot]
            return (columns[tree] >= 1) | (uniform(seed, numbers[tree], feature) < columns[tree])

        return allowed

    def split(self, found: dict, level: int) -> None:
        """Take the best splits of the open nodes."""
        trees, growth, following = self.trees, self.growth, []
        for i in np.argsort(found["slot"]):
            t, node = self.open[found["slot"][i]]
            h, g = found["h"][i], found["g"][i]
            trees.value[t, node], trees.weight[t, node] = leaf_value(g, h, growth), h
            if found["feature"][i] < 0 or level >= self.models[self.owner[t]].growth.depth:
                continue
            left = self.used[t]
            self.used[t] += 2
            if left + 2 > trees.feature.shape[1]:
                trees.widened(left + 2 - trees.feature.shape[1])
            trees.feature[t, node], trees.bin[t, node] = found["feature"][i], found["bin"][i]
            trees.left[t, node], trees.gain[t, node] = left, found["gain"][i]
            for child, part_h, part_g in ((left, found["left_h"][i], found["left_g"][i]),
                                          (left + 1, h - found["left_h"][i], g - found["left_g"][i])):
                trees.value[t, child], trees.weight[t, child] = leaf_value(part_g, part_h, growth), part_h
                following.append((t, child))
        self.open = following

    def finished(self) -> list[Trees]:
        out, at, names = [], 0, ("feature", "bin", "left", "value", "weight", "gain")
        for b in self.batch:
            out.append(Trees(*(getattr(self.trees, n)[at:at + len(b)] for n in names)))
            at += len(b)
        return out


def weights(part: Cells, models: list[Model], batch: list[list[int]]) -> np.ndarray:
    """Records of each cell that each tree of a batch gets."""
    out = np.concatenate([drawn(part.key, part.n, b, m.growth) for m, b in zip(models, batch) if b], axis=1)
    at = 0
    for model, b in zip(models, batch):
        if model.fold is not None:
            out[part.fold == model.fold, at:at + len(b)] = 0
        at += len(b)
    return out


def grow(data: Binned, models: list[Model], batch: list[list[int]]) -> list[Trees]:
    """New trees for each model, numbered as `batch` says; all of them together, level by level."""
    growing = Growing(models, batch)
    first, zero, bins, growth = data.first, data.zero, data.bins, growing.growth
    plain = [replace(m, grown=[]) for m in models]
    for level in range(max(m.growth.depth for m in models)):
        if not growing.open:
            break
        slot_of, allowed, trees, owners = growing.slots(), growing.chooser(), growing.trees, len(growing.owner)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                step = max(1, min(SLICE_PAIRS // owners, SLICE_CELLS // max(1, len(zero))))
                for low in range(0, whole.num_rows, step):
                    part = Cells.of(whole.slice(low, step), first, zero)
                    slots = slot_of[np.arange(owners), trees.leaves(part.dense)]
                    target = np.repeat(part.mean[:, None], owners, axis=1)
                    found = sums(slots, weights(part, plain, batch), target, part.at, part.ends, bins)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["k", "h", "g"])

        def search(entries: pa.Table) -> pa.Table:
            found = best_splits(*(entries.column(c).to_numpy() for c in ("k", "h", "g")), first, zero, allowed, growth)
            return pa.table({n: found[n] for n in SPLITS.names}, schema=SPLITS)

        group = F.pmod(F.floor(F.col("k") / (bins + 1)), F.lit(GROUPS)).alias("part")
        histogram = data.table.mapInArrow(rows, "k bigint, h double, g double").groupBy("k").agg(
            F.sum("h").alias("h"), F.sum("g").alias("g"))
        growing.split(histogram.groupBy(group).applyInArrow(
            search, "slot bigint, feature bigint, bin bigint, gain double, h double, g double, "
                    "left_h double, left_g double").toArrow().to_pydict(), level)
    return growing.finished()


def forest(data: Binned, count: int, growth: Growth, folds: list[int | None] | None = None) -> list[Trees]:
    """A forest for each training part: without a fold, or (None) on all cells."""
    models = [Model(growth, count, 1.0, fold) for fold in folds or [None]]
    out = grow(spread(data, count * len(models)), models, [list(range(count)) for _ in models])
    for grown in out:
        # A bootstrap of very few records may draw none at all: such a tree says what the others do.
        empty = grown.weight[:, 0] == 0
        if empty.any() and not empty.all():
            grown.value[empty, 0] = grown.value[~empty, 0].mean()
    return out


def spread(data: Binned, trees: int) -> Binned:
    """The same cells in as many parts as their work with so many trees asks for."""
    parts = max(1, data.cells * trees // TASK_PAIRS)
    return replace(data, table=data.table.repartition(parts, "_key") if parts > 1 else data.table)


def boost(data: Binned, models: list[Model]) -> list[Model]:
    """Boosted models, a tree each in turn; the models of a list grow side by side.

    A level of one tree is a small job, so its sums are merged as arrays of open nodes by bins in a tree of
    tasks, and only that array (32 nodes of 100 000 bins: 50 MB a model) comes to the driver.
    """
    grouped = data.table.groupBy(*(["fold"] if "fold" in data.table.columns else []))
    found = grouped.agg(F.sum(COUNT).alias("n"), F.sum(F.col(COUNT) * F.col(MEAN)).alias("y")).collect()
    table = data.table
    for m, model in enumerate(models):
        used = [r for r in found if model.fold is None or r.fold != model.fold]
        rows = sum(r.n or 0.0 for r in used)
        model.start = sum(r.y for r in used) / rows if rows else 0.0
        table = table.withColumn(f"_margin_{m}", F.lit(model.start))
    work, last = spread(replace(data, table=table), len(models)), max(m.trees for m in models)
    settings = [replace(m, grown=[]) for m in models]
    for written in range(0, last, WRITE_EVERY):
        held = [arrays(work, settings, written)]
        for turn in range(written, min(written + WRITE_EVERY, last)):
            batch = [[turn] if turn < m.trees else [] for m in models]
            new = boosted(work, held[-1], settings, batch, turn - written)
            for model, tree in zip(models, new):
                if len(tree.feature):
                    model.grown.append(tree)
            # What this turn has read is needed until the next turn has made its own.
            for old in held[:-1]:
                old.unpersist()
            held = [held[-1], held[-1].map(lambda part, new=new: part.advanced(settings, new)).persist()]
        for old in held:
            old.unpersist()
        if written + WRITE_EVERY < last:
            work = with_margins(work, models, written)
    return models


def arrays(data: Binned, models: list[Model], written: int) -> RDD:
    """The cells of each part as arrays, held by the executors; a lost one is made again from its part of the
    table and the trees since then."""
    first, zero = data.first, data.zero

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["b"])

    def unpacked(row) -> Cells:
        return Cells.of(pa.ipc.open_stream(row.b).read_next_batch(), first, zero).drawn(models, written)

    return data.table.mapInArrow(rows, "b binary").rdd.map(unpacked).persist()


def boosted(data: Binned, blocks: RDD, models: list[Model], batch: list[list[int]], turn: int) -> list[Trees]:
    """The next tree of each model."""
    growing = Growing(models, batch)
    bins, owner = data.bins, growing.owner
    for level in range(max(m.growth.depth for m in models)):
        if not growing.open or not data.cells:
            break
        slot_of, trees, count = growing.slots(), growing.trees, len(growing.open)

        def local(part: Cells) -> np.ndarray:
            slots = slot_of[np.arange(len(owner)), trees.leaves(part.dense)]
            target = np.stack([part.mean - part.margins[m] for m in owner], axis=1)
            weight = np.stack([part.draws[m][:, turn] for m in owner], axis=1)
            keys, h, g = sums(slots, weight, target, part.at, part.ends, bins)
            out = np.zeros((2, count * (bins + 1)))
            out[0, keys], out[1, keys] = h, g
            return out

        total = blocks.map(local).treeReduce(np.add)
        keys = np.flatnonzero(total[0])
        growing.split(best_splits(keys, total[0, keys], total[1, keys], data.first, data.zero, growing.chooser(),
                                  growing.growth), level)
    return growing.finished()


def with_margins(data: Binned, models: list[Model], written: int) -> Binned:
    """The cells with the predictions of all trees so far written beside them."""
    first, zero = data.first, data.zero
    fresh = [(m.step, m.grown[written:]) for m in models]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, SLICE_CELLS // max(1, len(zero)))
            for low in range(0, whole.num_rows, step):
                part = whole.slice(low, step)
                cells = Cells.of(part, first, zero)
                new = {f"_margin_{m}": pa.array(cells.margins[m] + rate * sum(
                    (tree.predicted(cells.dense)[:, 0] for tree in grown), np.zeros(part.num_rows)))
                    for m, (rate, grown) in enumerate(fresh)}
                yield pa.RecordBatch.from_arrays(
                    [new.get(n, c) for n, c in zip(part.schema.names, part.columns)], names=part.schema.names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in data.table.schema.fields)
    return replace(data, table=session.written(data.table.mapInArrow(rows, schema), "margins"))


def forest_mean(trees: Trees) -> Callable[[np.ndarray], np.ndarray]:
    return lambda dense: trees.predicted(dense).mean(axis=1)


def boosted_sum(model: Model) -> Callable[[np.ndarray], np.ndarray]:
    def predicted(dense: np.ndarray) -> np.ndarray:
        return model.start + model.step * sum(
            (tree.predicted(dense)[:, 0] for tree in model.grown), np.zeros(len(dense)))

    return predicted


def held_out_r2(data: Binned, predictors: list[tuple[int, Callable]]) -> list[float]:
    """r2 over the records of a fold, for each (fold, predictor); all in one pass over the cells."""
    first, zero = data.first, data.zero

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, SLICE_CELLS // max(1, len(zero)))
            for low in range(0, whole.num_rows, step):
                part = whole.slice(low, step)
                cells = Cells.of(part, first, zero)
                s, q = part.column(SUM).to_numpy(), part.column(SQUARES).to_numpy()
                errors = []
                for fold, predictor in predictors:
                    own = cells.fold == fold
                    p, n = predictor(cells.dense[own]), cells.n[own]
                    errors.append(float((q[own] - 2 * p * s[own] + n * p * p).sum()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(errors)), pa.int32()), pa.array(errors)], names=["at", "error"])

    error = {r.at: r.error for r in data.table.mapInArrow(rows, "at int, error double").groupBy("at").agg(
        F.sum("error").alias("error")).collect()}
    spread = {r.fold: r.q - r.s * r.s / r.n for r in data.table.groupBy("fold").agg(
        F.sum(SQUARES).alias("q"), F.sum(SUM).alias("s"), F.sum(COUNT).alias("n")).collect()}
    return [1 - error[at] / spread[fold] if spread.get(fold) else float("nan")
            for at, (fold, _) in enumerate(predictors)]


def records_of(trees: Trees, data: Binned, first_tree: int = 0) -> list[dict]:
    """Nodes as rows of Spark's own tables of trees, numbered from the root down, left side first."""
    out = []
    for t in range(len(trees.feature)):
        order, stack = {}, [0]
        while stack:
            node = stack.pop()
            order[node] = len(order)
            if trees.feature[t, node] >= 0:
                stack += [int(trees.left[t, node]) + 1, int(trees.left[t, node])]
        for node, number in order.items():
            feature, left = int(trees.feature[t, node]), int(trees.left[t, node])
            inner = feature >= 0
            weight, value = float(trees.weight[t, node]), float(trees.value[t, node])
            out.append({"treeID": first_tree + t, "nodeData": {
                "id": number, "prediction": value, "impurity": 0.0,
                "impurityStats": [weight, weight * value, weight * value * value], "rawCount": int(weight),
                "gain": float(trees.gain[t, node]) if inner else -1.0,
                "leftChild": order[left] if inner else -1, "rightChild": order[left + 1] if inner else -1,
                "split": {"featureIndex": feature, "leftCategoriesOrThreshold":
                          [float(data.cuts[trees.bin[t, node]])] if inner else [], "numCategories": -1}}})
    return out


NODES = pa.schema([("treeID", pa.int32()), ("nodeData", pa.struct([
    ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()),
    ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()), ("gain", pa.float64()),
    ("leftChild", pa.int32()), ("rightChild", pa.int32()), ("split", pa.struct([
        ("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())),
        ("numCategories", pa.int32())]))]))])


def loaded(spark: SparkSession, kind: type, rows: list[dict], weights: list[float], width: int):
    """A model of Spark's own kind, for pipelines and for saving: written in the form it is saved in, and read."""
    path, settings = session.scratch_path(spark, "trees"), {
        "featuresCol": FEATURES, "predictionCol": "prediction", "impurity": "variance"}
    own = {"numTrees": len(weights)} if kind is RandomForestRegressionModel else {}

    def described(name: str, **more: int) -> str:
        return json.dumps({
            "class": f"org.apache.spark.ml.regression.{name}", "timestamp": 0, "sparkVersion": spark.version,
            "uid": f"{name}_{uuid.uuid4().hex[:12]}", "paramMap": {**settings, **more}, "defaultParamMap": {"leafCol": ""},
            "numFeatures": width, "numTrees": len(weights)})

    spark.createDataFrame([(described(kind.__name__, **own),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(pa.Table.from_pylist(rows, NODES)).write.parquet(f"{path}/data")
    spark.createDataFrame([(i, described("DecisionTreeRegressionModel"), w) for i, w in enumerate(weights)],
                          "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
    return kind.load(path)


def forest_model(spark: SparkSession, trees: Trees, data: Binned) -> RandomForestRegressionModel:
    return loaded(spark, RandomForestRegressionModel, records_of(trees, data), [1.0] * len(trees.feature), len(data.zero))


def boosted_model(spark: SparkSession, model: Model, data: Binned) -> GBTRegressionModel:
    start = Trees.roots(1)
    start.value[:] = model.start
    rows = records_of(start, data)
    for number, tree in enumerate(model.grown):
        rows += records_of(tree, data, number + 1)
    return loaded(spark, GBTRegressionModel, rows, [1.0, *[model.step] * len(model.grown)], len(data.zero))
