"""Mergeable summaries, kept per fiscal year: quantiles, distinct values and heavy hitters.

Exact statistics stay the default. A summary of a year is a few kilobytes a column, is made once when
the year is loaded, and summaries of any range of years are merged without reading a record. Errors are bounded and
can be measured against the records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipendia.operators.tall import tall

#: Size of a quantile sketch (about 10 kB) and the error in rank, as a share of all rows, that it stays below
#: with near certainty; size of a distinct sketch (2**14 hashes, 128 kB; exact below) and its relative error.
QUANTILE_SIZE, RANK_ERROR = 800, 0.01
DISTINCT_BITS, DISTINCT_ERROR = 14, 0.03
PARTS = 64


def quantile_sketches(df: DataFrame, columns: list[str], period: str = "fiscal_year",
                      size: int = QUANTILE_SIZE) -> DataFrame:
    """One sketch for each period and column; nulls are not values."""
    values = tall(df, columns, "double", keep=[period]).where(F.col("value").isNotNull())
    return values.groupBy(period, "column_name").agg(
        F.count("*").alias("n"), F.kll_sketch_agg_double("value", size).alias("sketch"))


def merged_quantiles(stored: DataFrame, probabilities: list[float]) -> DataFrame:
    """column_name, n, probability and value, from the sketches of the chosen periods."""
    merged = stored.groupBy("column_name").agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    asked = F.explode(F.array(*[
        F.struct(F.lit(p).alias("probability"), F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias("value"))
        for p in probabilities])).alias("q")
    return merged.select("column_name", "n", asked).select("column_name", "n", "q.*")


def rank_errors(estimates: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """The estimates with how far, as a share of all rows, the wanted rank lies from the ranks of the value."""
    values = tall(df, columns, "double").where(F.col("value").isNotNull()).withColumnRenamed("value", "_v")
    found = values.join(estimates, "column_name").groupBy("column_name", "n", "probability", "value").agg(
        F.count("*").alias("_n"), F.count_if(F.col("_v") < F.col("value")).alias("_below"),
        F.count_if(F.col("_v") <= F.col("value")).alias("_upto"))
    p = F.col("probability")
    error = F.greatest(F.col("_below") / F.col("_n") - p, p - F.col("_upto") / F.col("_n"), F.lit(0.0))
    return found.select("column_name", F.col("_n").alias("n"), "probability", "value", error.alias("rank_error"))


def distinct_sketches(df: DataFrame, columns: list[str], period: str = "fiscal_year",
                      bits: int = DISTINCT_BITS) -> DataFrame:
    """One sketch of the different values for each period and column; nulls are not values."""
    values = tall(df, columns, "string", keep=[period]).where(F.col("value").isNotNull())
    return values.groupBy(period, "column_name").agg(F.theta_sketch_agg("value", bits).alias("sketch"))


def distinct_in_any(stored: DataFrame, bits: int = DISTINCT_BITS) -> DataFrame:
    """column_name and about how many values occur in any of the chosen periods."""
    union = F.theta_sketch_estimate(F.theta_union_agg("sketch", bits))
    return stored.groupBy("column_name").agg(union.alias("distinct_values"))


def distinct_in_all(stored: DataFrame) -> DataFrame:
    """column_name and about how many values occur in each of the chosen periods."""
    both = F.theta_sketch_estimate(F.theta_intersection_agg("sketch"))
    return stored.groupBy("column_name").agg(both.alias("distinct_values"))


def near(estimate: Column, exact: Column, share: float = DISTINCT_ERROR) -> Column:
    return F.abs(estimate - exact) <= share * exact


def reduced(counts: dict, size: int) -> dict:
    """At most `size` counters: all are lowered by the largest that has to go."""
    if len(counts) <= size:
        return counts
    cut = sorted(counts.values(), reverse=True)[size]
    return {value: n - cut for value, n in counts.items() if n > cut}


def summaries(df: DataFrame, columns: list[str], size: int) -> DataFrame:
    """column_name, value, n: counters that are too low by at most n / (size + 1) of all n values.

    Every task keeps `size` counters a column; they are merged in PARTS groups and then in one, so no
    task sees more than the counters of its share of the tasks.
    """
    schema = "column_name string, value string, n bigint"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {c: {} for c in columns}
        for batch in batches:
            for c in columns:
                own = held[c]
                for pair in pc.value_counts(batch.column(c).drop_null()).to_pylist():
                    own[pair["values"]] = own.get(pair["values"], 0) + pair["counts"]
                held[c] = reduced(own, size)
        rows = [(c, v, n) for c in columns for v, n in held[c].items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))],
            names=["column_name", "value", "n"])

    def merged(table: pa.Table) -> pa.Table:
        total: dict[str, int] = {}
        for v, n in zip(table.column("value").to_pylist(), table.column("n").to_pylist()):
            total[v] = total.get(v, 0) + n
        kept = reduced(total, size)
        name = table.column("column_name")[0].as_py()
        return pa.table({"column_name": [name] * len(kept), "value": list(kept), "n": list(kept.values())},
                        schema=pa.schema([("column_name", pa.string()), ("value", pa.string()), ("n", pa.int64())]))

    plain = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    per_task = plain.mapInArrow(counted, schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    groups = per_task.groupBy("column_name", "part").applyInArrow(merged, schema)
    return groups.groupBy("column_name").applyInArrow(merged, schema)


def heavy_hitters(df: DataFrame, columns: list[str], size: int = 50) -> DataFrame:
    """column_name, value and exact n of every value with more than one in `size` of a column's values.

    The summaries hold all of them, as a counter is too low by less than n / size; a second pass counts the
    candidates, at most `size` a column.
    """
    candidates = summaries(df, columns, size).select("column_name", "value")
    values = tall(df, columns, "string").where(F.col("value").isNotNull())
    totals = values.groupBy("column_name").agg(F.count("*").alias("total"))
    counted = values.join(candidates, ["column_name", "value"]).groupBy("column_name", "value").agg(
        F.count("*").alias("n"))
    return counted.join(totals, "column_name").where(F.col("n") * size > F.col("total")).drop("total")
