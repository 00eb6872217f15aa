"""Exact order statistics and row numbers that never put a whole group into one task.

The value axis is cut into steps. Rows per step are counted first, a running total over
the few steps of a group gives the rank at which each step starts, and only then are the
values inside one step put in order. A group that holds a third of all rows is thereby
spread over all its steps, and equal values are counted, not repeated.

A step has a fixed width, for values whose range is known (money, years), or none: steps are then stretches of about
equally many different values, cut where Spark's range partitioning samples them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipendia import session

MONEY_STEP = 1000.0
YEARS_STEP = 1.0


def join_on(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", filled: str = ""
) -> DataFrame:
    """Equi-join in which a null key meets a null key; the right keys are dropped.

    `filled` names a key that is never null, which takes a plain equality. Without keys the right side must
    be one row.
    """
    if not keys:
        return left.crossJoin(right)
    twins = right.select(*[F.col(c).alias("_r_" + c if c in keys else c) for c in right.columns])
    tests = [F.col(k) == F.col("_r_" + k) if k == filled else
             F.col(k).eqNullSafe(F.col("_r_" + k)) for k in keys]
    return left.join(twins, reduce(Column.__and__, tests), how).drop(*["_r_" + k for k in keys])


def fold(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Put aggregates with the same keys side by side, without a join.

    Each frame has one row per key, so the union has a handful and max() picks the only
    value there is. Works for null keys and for no keys at all.
    """
    tall = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    values = [c for c in tall.columns if c not in keys]
    return tall.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])


def value_counts(df: DataFrame, keys: list[str], value: Column, weight: Column | None = None):
    """One row per (keys, value): the value as `_v`, how often it occurs as `_n`."""
    times = F.count(F.lit(1)) if weight is None else F.sum(weight)
    tall = df.withColumn("_v", value.cast("double")).where(F.col("_v").isNotNull())
    return tall.groupBy(*keys, "_v").agg(times.alias("_n"))


def with_steps(counts: DataFrame, keys: list[str], step: float | None) -> DataFrame:
    """The step of each counted value as `_step`, rising with the value inside each group.

    With a width, its multiples. Without one the different values of all groups are cut into stretches of about equal
    length in the order of (keys, value), whatever their range and however uneven; the table is written,
    since two samples would cut differently. Values of one stretch and group are one step. Counts that have steps
    keep them, so several statistics can share one written table.
    """
    if "_step" in counts.columns:
        return counts
    if step is not None:
        return counts.withColumn("_step", F.floor(F.col("_v") / step))
    ranged = counts.repartitionByRange(*keys, "_v").withColumn("_step", F.spark_partition_id().cast("long"))
    return session.written(ranged, "steps")


def _steps(stepped: DataFrame, keys: list[str]) -> DataFrame:
    """Per step: rows before it (`_before`), rows in it (`_in`), rows of the group (`_total`)."""
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return (
        stepped.groupBy(*keys, "_step").agg(F.sum("_n").alias("_in"))
        .withColumn("_total", F.sum("_in").over(group))
        .withColumn("_before", F.sum("_in").over(group.orderBy("_step")) - F.col("_in"))
    )


def _positions(stepped: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """Per value: the half-open range of ranks it covers, `_from` .. `_to`."""
    inside = Window.partitionBy(*keys, "_step").orderBy("_v")
    return (
        join_on(stepped, steps, [*keys, "_step"], "inner")
        .withColumn("_to", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_from", F.col("_to") - F.col("_n"))
    )


def value_positions(counts: DataFrame, keys: list[str], step: float | None) -> DataFrame:
    """Rank range and group size for every distinct value of every group."""
    stepped = with_steps(counts, keys, step)
    return _positions(stepped, _steps(stepped, keys), keys)


def quantiles_of_counts(
    counts: DataFrame, keys: list[str], probs: dict[str, float], step: float | None
) -> DataFrame:
    """Exact, linearly interpolated quantiles of (value, count) rows, one column per name."""
    stepped = with_steps(counts, keys, step)
    steps = _steps(stepped, keys)

    def place(p: float) -> Column:
        return F.lit(p) * (F.col("_total") - 1)

    def covers(rank: Column, start: str, end: Column) -> Column:
        return (F.col(start) <= rank) & (rank < end)

    wanted = [r(place(p)) for p in set(probs.values()) for r in (F.floor, F.ceil)]
    end_of_step = F.col("_before") + F.col("_in")
    needed = steps.where(reduce(Column.__or__, [covers(r, "_before", end_of_step) for r in wanted]))

    out = []
    for name, p in probs.items():
        low, high = [
            F.max(F.when(covers(r(place(p)), "_from", F.col("_to")), F.col("_v")))
            for r in (F.floor, F.ceil)
        ]
        part = F.max(place(p) - F.floor(place(p)))
        out.append((low + (high - low) * part).alias(name))
    return _positions(stepped, needed, keys).groupBy(*keys).agg(*out)


def moments_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """count, mean, std (sample), min and max of (value, count) rows."""
    v, n = F.col("_v"), F.col("_n")
    total = F.sum(n)
    mean = F.sum(n * v) / total
    squares = F.sum(n * v * v) - total * mean * mean
    spread = F.when(total > 1, F.sqrt(F.greatest(F.try_divide(squares, total - 1), F.lit(0.0))))
    return counts.groupBy(*keys).agg(
        total.alias("count"), mean.alias("mean"), spread.alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"))


def quantiles(
    df: DataFrame, keys: list[str], value: Column, probs: dict[str, float],
    step: float | None = MONEY_STEP
) -> DataFrame:
    return quantiles_of_counts(value_counts(df, keys, value), keys, probs, step)


def summarize(
    df: DataFrame, keys: list[str], aggregates: list[Column], *quantile_sets
) -> DataFrame:
    """groupBy(keys).agg(aggregates) plus exact quantiles.

    Each quantile set is (value column, {name: probability}, step).
    """
    frames = [df.groupBy(*keys).agg(*aggregates)]
    frames += [quantiles(df, keys, v, probs, step) for v, probs, step in quantile_sets]
    return fold(frames, keys)


def row_mark(columns: list[str], numbers: list[str] = ()) -> Column:
    """A hexadecimal digest of all columns, nulls included.

    Rows that differ get different marks, so an order by mark depends on the data only. `numbers` are written
    with six digits after the point, as other engines can do alike.
    """
    def shown(c: str) -> Column:
        value = F.round(F.col(c), 6).cast("decimal(30,6)") if c in numbers else F.col(c)
        return F.coalesce(value.cast("string"), F.lit("~"))

    return F.md5(F.concat_ws("|", *map(shown, columns)))


def labelled(df: DataFrame, keys: list[str], mark: Column, label, name: str) -> DataFrame:
    """A label by place in the order of marks of each group.

    `label(row, total)` must not fall as the row number rises. Marks are cut into 65536
    slots by their first digits; slots are counted, and the few slots in which the label changes are kept
    as one row a group. All rows of other slots get their label from that row. Only
    rows of the slots with a change are put in order.
    """
    # A slot that cannot be null needs no test for it, which would make the mark a second time.
    slot = F.coalesce(F.conv(F.substring("_mark", 1, 4), 16, 10).cast("long"), F.lit(0))
    marked = df.withColumn("_mark", mark).withColumn("_slot", slot)
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    along = group.orderBy("_slot")
    counted = marked.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_in"))
    slots = counted.withColumns({
        "_total": F.sum("_in").over(group), "_before": F.sum("_in").over(along) - F.col("_in"),
    }).withColumns({
        "_first": label(F.col("_before"), F.col("_total")),
        "_last": label(F.col("_before") + F.col("_in") - 1, F.col("_total")),
    }).withColumn("_prior", F.lag("_last").over(along))
    changes = slots.where("_prior is null or _first <> _prior or _first <> _last").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_slot", "_first", "_last", "_before"))).alias("_changes"),
        F.collect_list(F.when(F.col("_first") != F.col("_last"), F.col("_slot"))).alias("_open"),
        F.max("_total").alias("_total"))
    joined = join_on(marked, changes, keys, "inner")
    # Rows are told apart by a plain test; the change that a row is at is looked up once, for the row's label.
    open_ = F.array_contains("_open", F.col("_slot"))
    at = F.element_at(F.filter("_changes", lambda c: c["_slot"] <= F.col("_slot")), -1)
    inside = Window.partitionBy(*keys, "_slot").orderBy("_mark", *(
        c for c, kind in df.dtypes if not kind.startswith("map")))
    row = at["_before"] + F.row_number().over(inside) - 1
    sure = joined.where(~open_).withColumn(name, at["_last"])
    placed = joined.where(open_).withColumn("_row", row).withColumn(
        name, label(F.col("_row"), F.col("_total"))).drop("_row")
    return sure.unionByName(placed).drop("_mark", "_slot", "_changes", "_open", "_total")
