"""Ranks, quantiles, folds and histograms against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stipendia.operators import folds, ranks
from stipendia.operators.histogram import histogram
from stipendia.plans import recipes


@pytest.fixture(scope="module")
def skewed(spark):
    """A hot group with one value in a third of its rows, a null key, null values, a single row."""
    rng = np.random.default_rng(7)
    hot = np.concatenate([np.full(400, 52_000.0), np.round(rng.gamma(3, 20_000, 800), 2)])
    pdf = pd.DataFrame({"k": ["hot"] * 1200 + [None] * 55 + ["one"],
                        "v": [*hot, *np.round(rng.normal(0, 5_000, 55), 2), 9.5]})
    pdf.loc[5:9, "v"] = None
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k string, v double"), pdf


@pytest.mark.parametrize("step", [7.0, 1000.0, 1e9, None])
def test_quantiles_equal_linear_interpolation(skewed, step):
    df, pdf = skewed
    probs = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.9, "e": 0.99, "f": 1.0}
    found = {r.k: r for r in ranks.quantiles(df, ["k"], F.col("v"), probs, step).collect()}
    for key, group in pdf.groupby("k", dropna=False):
        row = found[None if pd.isna(key) else key]
        for name, p in probs.items():
            assert row[name] == pytest.approx(group.v.quantile(p), abs=1e-9)
    whole = ranks.quantiles(df, [], F.col("v"), {"m": 0.5}, step).first()
    assert whole.m == pytest.approx(pdf.v.median(), abs=1e-9)


def test_steps_follow_the_values(spark):
    """A narrow column, one with far outliers and one constant: no step holds more than a tenth of a column."""
    rows = spark.range(40_000).selectExpr("""stack(3, 'ratio', id / 1e6d, 'tail',
        if(id < 3, power(10d, 9 + id), id / 1e3d), 'same', 5d) as (k, v)""")
    counts = ranks.value_counts(rows, ["k"], F.col("v"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        stepped = ranks.with_steps(counts, ["k"], None)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sizes = stepped.groupBy("k", "_step").agg(F.count("*").alias("n"), F.min("_v").alias("low"),
                                              F.max("_v").alias("high")).collect()
    assert max(r.n for r in sizes) <= 4000
    for key in ("ratio", "tail"):
        ends = sorted((r._step, r.low, r.high) for r in sizes if r.k == key)
        assert len(ends) > 10 and all(a[2] < b[1] for a, b in zip(ends, ends[1:]))
    found = ranks.quantiles_of_counts(stepped, ["k"], {"m": 0.5}, None).collect()
    assert {r.k: round(r.m, 7) for r in found} == {"ratio": 0.0199995, "tail": 20.0025, "same": 5.0}


def test_summarize_keeps_null_keys_and_groups_without_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", None)], "k string, v double")
    found = {r.k: (r.n, r.m) for r in ranks.summarize(
        df, ["k"], [F.count("*").alias("n")], (F.col("v"), {"m": 0.5}, 1.0)).collect()}
    assert found == {None: (2, 2.0), "x": (1, None)}


def test_mean_rank(skewed):
    df, pdf = skewed
    values = ranks.value_positions(ranks.value_counts(df, ["k"], F.col("v")), ["k"], 1000.0)
    found = {(r.k, r._v): (r._from + r._to + 1) / 2 for r in values.collect()}
    rank = pdf.groupby("k", dropna=False).v.rank()
    for key, value, expected in zip(pdf.k, pdf.v, rank):
        if not pd.isna(value):
            assert found[(None if pd.isna(key) else key, value)] == expected


def test_contiguous_folds(spark):
    df = spark.range(103).select("id", (F.col("id") % 7).alias("x"))
    sizes = folds.contiguous_folds(df, 5).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in sizes] == [21, 21, 21, 20, 20]
    again = folds.contiguous_folds(df.repartition(3), 5)
    both = folds.contiguous_folds(df, 5).join(again, ["id", "x", "fold"])
    assert both.count() == 103
    grouped = folds.group_folds(df, 3, [F.col("x")])
    assert grouped.groupBy("x").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def test_histogram_equals_numpy(spark, skewed):
    df, pdf = skewed
    v = pdf.v.dropna().to_numpy()
    counts = ranks.value_counts(df, [], F.col("v")).withColumn("column_name", F.lit("v"))
    for bins in (50, None):
        expected, edges = np.histogram(v, bins if bins else "auto")
        rows = histogram(counts, ["column_name"], bins, 1000.0).collect()
        got = np.zeros(len(expected))
        for r in rows:
            got[r.bin] = r.n
            assert r.bin_low == pytest.approx(edges[r.bin])
        assert got.sum() == len(v) and np.abs(got - expected).sum() <= 2


def test_stratified_sample_takes_the_share_of_a_hot_stratum(spark):
    df = spark.range(3001).select(
        "id", F.when(F.col("id") < 3000, "hot").otherwise("rare").alias("s"))
    found = recipes.stratified_sample(df, ["s"], 0.3, F.md5(F.col("id").cast("string")))
    assert {r.s: r["count"] for r in found.groupBy("s").count().collect()} == {"hot": 900}


def test_year_relative(spark):
    rows = [(2020, s) for s in (10.0, 20.0, 20.0, 40.0)] + [(2021, 5.0)]
    df = spark.createDataFrame(rows, "fiscal_year int, base_salary double")
    found = recipes.year_relative_salary(df).orderBy("fiscal_year", "base_salary").collect()
    assert [r.salary_percentile_by_year for r in found] == [0.25, 0.625, 0.625, 1.0, 1.0]
    assert found[3].salary_vs_year_median == 2.0


def test_agency_prestige_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 3.0)],
                               "agency_std string, base_salary double")
    found = {r.agency_std: r.agency_prestige for r in recipes.agency_prestige(df).collect()}
    assert found == {"a": 0.25, "b": 0.625, "c": 0.625, "d": 1.0}


def test_marks_tell_cents_and_nulls_apart(spark):
    df = spark.createDataFrame(
        [(1.25, None), (1.26, None), (None, 1.25), (None, 1.26)], "a double, b double")
    for numbers in ((), ("a", "b")):
        marks = df.select(ranks.row_mark(["a", "b"], numbers).alias("m")).distinct()
        assert marks.count() == 4


def test_labels_do_not_depend_on_partitions(spark):
    # Four marks only: labels change inside a slot, and ties are broken by the row.
    df = spark.range(2000).select("id", (F.col("id") % 4).alias("g"), (F.col("id") % 3).alias("k"))
    mark = F.md5(F.col("g").cast("string"))

    def third(row, total):
        return F.floor(row * 3 / total).cast("int")

    for keys in ([], ["k"]):
        one = ranks.labelled(df, keys, mark, third, "label")
        two = ranks.labelled(df.repartition(7), keys, mark, third, "label")
        assert one.exceptAll(two).count() == 0 and one.count() == 2000
        sizes = [r["count"] for r in one.groupBy(*keys, "label").count().collect()]
        assert max(sizes) - min(sizes) <= 2


def test_folds_keep_wanted_columns_and_make_digests_once(spark):
    rows = [(i % 7, i / 3, None if i % 5 == 0 else f"t{i % 11}") for i in range(200)] + [(1, 0.5, "x")] * 9
    df = spark.createDataFrame(rows, "a int, b double, c string")
    kept = folds.contiguous_folds(df, 4, keep=["c", "a"])
    assert kept.columns == ["a", "c", "fold"]
    assert "md5" not in kept._jdf.queryExecution().optimizedPlan().toString()
    whole = folds.contiguous_folds(df, 4)
    assert sorted(map(str, whole.select(*kept.columns).collect())) == sorted(map(str, kept.collect()))
    marks = df.select(ranks.row_mark(df.columns).alias("m"), "a", "c").orderBy("m").collect()
    sizes = [53, 52, 52, 52]
    placed = [f for f, n in enumerate(sizes) for _ in range(n)]
    assert sorted(map(str, kept.collect())) == sorted(
        f"Row(a={r.a}, c={r.c!r}, fold={f})" for r, f in zip(marks, placed))
