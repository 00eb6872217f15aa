"""Mergeable summaries against exact statistics on hard inputs."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from stipendia.plans import sketches


@pytest.fixture(scope="module")
def years(spark):
    """Three years; a value that fills half of a column, ascending values, and gaps."""
    return spark.range(0, 60_000, 1, 6).select(
        (2020 + F.col("id") % 3).alias("fiscal_year"), F.col("id").cast("double").alias("up"),
        F.when(F.col("id") % 2 == 0, 5.0).otherwise((F.col("id") * 7919 % 30_011).cast("double")).alias("half"),
        F.when(F.col("id") % 10 != 0, (F.col("id") % 100).cast("double")).alias("gaps"))


def test_quantiles_of_merged_years_are_within_the_bound(years):
    stored = sketches.quantile_sketches(years, ["up", "half", "gaps"])
    assert stored.count() == 9
    for chosen in (years, years.where("fiscal_year > 2020")):
        kept = stored if chosen is years else stored.where("fiscal_year > 2020")
        found = sketches.merged_quantiles(kept, [0.01, 0.25, 0.5, 0.9, 0.99])
        errors = sketches.rank_errors(found, chosen, ["up", "half", "gaps"]).collect()
        assert len(errors) == 15 and max(r.rank_error for r in errors) <= sketches.RANK_ERROR
        assert {r.n for r in errors if r.column_name == "gaps"} == {chosen.where("gaps is not null").count()}


def test_distinct_values_of_any_and_of_all_years(spark):
    df = spark.range(90_000).select((2020 + F.col("id") % 2).alias("fiscal_year"), F.when(
        F.col("id") % 2 == 0, F.col("id") % 50_000).otherwise(F.col("id") % 30_000).alias("a"),
        (F.col("id") % 7).alias("c"))
    df = df.select("fiscal_year", "a", "c", F.when(F.col("c") == 3, None).otherwise(F.col("c")).alias("some"))
    stored = sketches.distinct_sketches(df, ["a", "c", "some"])
    any_year = {r.column_name: r.distinct_values for r in sketches.distinct_in_any(stored).collect()}
    exact = df.select(*[F.count_distinct(c).alias(c) for c in ("a", "c", "some")]).first()
    assert any_year["c"] == 7 and any_year["some"] == 6
    assert any_year["a"] == pytest.approx(exact.a, rel=sketches.DISTINCT_ERROR)
    every = {r.column_name: r.distinct_values for r in sketches.distinct_in_all(stored).collect()}
    common = df.where("fiscal_year = 2020").select("a").intersect(df.where("fiscal_year = 2021").select("a")).count()
    assert every["c"] == 7 and every["a"] == pytest.approx(common, abs=sketches.DISTINCT_ERROR * exact.a)


@pytest.mark.parametrize("order", ["id", "-id", "n"])
def test_counters_hold_every_frequent_value_in_any_order(spark, order):
    # Rare values come in waves that push out the counters of values seen before.
    values = ["a"] * 300 + [f"x{i}" for i in range(700)] + ["b"] * 150 + [f"y{i % 350}" for i in range(700)] + ["c"] * 101
    size, counts = 20, Counter(values)
    df = spark.createDataFrame([(i, v, i * 7919 % 1951) for i, v in enumerate(values)], "id int, v string, n int")
    df = df.repartitionByRange(5, "id").sortWithinPartitions(F.expr(order)).select("v")
    kept = {r.value: r.n for r in sketches.summaries(df, ["v"], size).collect()}
    assert len(kept) <= size
    for value, n in counts.items():
        assert n - len(values) / (size + 1) <= kept.get(value, 0) <= n
    found = {r.value: r.n for r in sketches.heavy_hitters(df, ["v"], size).collect()}
    assert found == {v: n for v, n in counts.items() if n * size > len(values)}


def test_empty_tables(spark, years):
    none = years.where("false")
    assert sketches.quantile_sketches(none, ["up"]).count() == 0
    assert sketches.distinct_sketches(none, ["up"]).count() == 0
    assert sketches.heavy_hitters(none, ["up"]).count() == 0
