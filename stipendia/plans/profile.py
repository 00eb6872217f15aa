"""Data profiling of any table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stipendia.functions.scalars import count_where, percent
from stipendia.operators.histogram import histogram
from stipendia.operators.ranks import (
    fold, moments_of_counts, quantiles_of_counts, value_counts, with_steps,
)
from stipendia.operators.tall import tall, tall_row

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def dedup_report(df: DataFrame) -> DataFrame:
    """Rows before and after removing repeated rows."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return groups.agg(
        F.sum("_n").alias("rows_before"), F.count("*").alias("rows_after"),
        (F.sum("_n") - F.count("*")).alias("removed"),
    )


def missing_profile(df: DataFrame, top: int = 20) -> DataFrame:
    counts = df.agg(*[count_where(F.col(c).isNull()).alias(f"{c}__missing") for c in df.columns])
    return (
        tall_row(counts, df.columns, ["missing"])
        .orderBy(F.desc("missing"), "column_name").limit(top)
    )


def numeric_profile(df: DataFrame, columns: list[str], step: float | None = None) -> DataFrame:
    """count, mean, sample deviation, minimum, quartiles and maximum per column.

    Everything follows from one table of counted values, so the input is read once. Columns differ in range
    (ratios, years, pay), so steps follow the values unless a width is given.
    """
    key = ["column_name"]
    counts = with_steps(value_counts(tall(df, columns, "double"), key, F.col("value")), key, step)
    return fold([moments_of_counts(counts, key),
                 quantiles_of_counts(counts, key, QUARTILES, step)], key)


def cardinality_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact number of distinct values per column; null is not a value."""
    values = tall(df, columns, "string").groupBy("column_name", "value").count()
    return values.groupBy("column_name").agg(F.count("value").alias("distinct_values"))


def top_values(df: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """Most frequent values per column, null included, with the share of all rows.

    The limit on the row number lets every task keep only its best `top` values per column
    before the window shuffles.
    """
    by_column = Window.partitionBy("column_name")
    totals = df.agg(F.count("*")).scalar()
    counts = tall(df, columns, "string").groupBy("column_name", "value").agg(
        F.count("*").alias("n"))
    order = by_column.orderBy(F.desc("n"), F.asc_nulls_first("value"))
    return (
        counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
        .withColumn("pct", percent(F.col("n"), totals))
    )


def value_shares(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """How often each value of one column occurs and its share of all rows, null included."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    shares = counts.withColumn("pct", percent(F.col("n"), df.agg(F.count("*")).scalar()))
    if top is None:
        return shares
    return shares.orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(top)


def sign_checks(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = df.agg(
        *[count_where(F.col(c) < 0).alias(f"{c}__negative") for c in columns],
        *[count_where(F.col(c) == 0).alias(f"{c}__zero") for c in columns],
    )
    return tall_row(counts, columns, ["negative", "zero"])


def numeric_histograms(df: DataFrame, columns: list[str]) -> DataFrame:
    """Histogram of every given column, number of bins chosen per column."""
    key = ["column_name"]
    counts = with_steps(value_counts(tall(df, columns, "double"), key, F.col("value")), key, None)
    return histogram(counts, key, None, None)


def head_sample(df: DataFrame, order: list[str], rows: int = 200) -> DataFrame:
    return df.orderBy(*order).limit(rows)
