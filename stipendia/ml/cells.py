"""Training data as cells: one row per distinct model input.

All model inputs depend on agency, title, category and year, so billions of records share a few
ten thousand input rows. A cell keeps the number of its records and the sum and the sum of
squares of the target; least squares, penalties and squared-error trees need no more. Every
pass of a solver then reads the cells and not the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipendia.session import durable

TARGET = "log_base_salary"
COUNT, MEAN, SUM, SQUARES = "_count", "_mean", "_sum", "_squares"


def prepared(df: DataFrame, categorical: list[str], numeric: list[str], *keep: str) -> DataFrame:
    """Inputs in their model types; a missing category is a category of its own."""
    return df.select(
        *keep,
        *[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in categorical],
        *[F.col(c).cast("double").alias(c) for c in numeric],
    )


def cells(df: DataFrame, categorical: list[str], numeric: list[str], *keep: str) -> DataFrame:
    """Cells of a table, kept apart by the `keep` columns, in the shared folder."""
    y = F.col(TARGET)
    grouped = prepared(df, categorical, numeric, *keep, TARGET).where(y.isNotNull()).groupBy(
        *keep, *categorical, *numeric)
    sums = grouped.agg(F.count("*").cast("double").alias(COUNT), F.sum(y).alias(SUM),
                       F.sum(y * y).alias(SQUARES))
    return durable(sums.withColumn(MEAN, F.col(SUM) / F.col(COUNT)))


def cell_r2(predictions: DataFrame) -> float:
    """r2 over the records behind the cells."""
    p, n, s, q = F.col("prediction"), F.col(COUNT), F.col(SUM), F.col(SQUARES)
    error = F.sum(q - 2 * p * s + n * p * p)
    total = F.sum(q) - F.sum(s) * F.sum(s) / F.sum(n)
    return predictions.agg(1 - error / total).first()[0]


def metrics(actual: Column, prediction: Column, weight: Column) -> Column:
    """Records, r2, RMSE and MAE as one aggregate."""
    error, total = actual - prediction, F.sum(weight)
    squares = F.sum(weight * error * error)
    centre = F.sum(weight * actual) / total
    variance = F.sum(weight * actual * actual) - total * centre * centre
    return F.struct(
        total.cast("long").alias("rows"), (1 - squares / variance).alias("r2"),
        F.sqrt(squares / total).alias("rmse"), (F.sum(weight * F.abs(error)) / total).alias("mae"),
    )
