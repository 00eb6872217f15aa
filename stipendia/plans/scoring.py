"""Scores of predictions and the registry of models, as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipendia.functions.scalars import percent

DEFAULT_MODEL = "linear"


def regression_metrics(df: DataFrame, actual: Column, predicted: Column, *keys: str) -> DataFrame:
    """r2, RMSE and MAE in one pass."""
    error = actual - predicted
    squares = F.avg(error * error)
    return df.where(error.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("rows"), (1 - F.try_divide(squares, F.var_pop(actual))).alias("r2"),
        F.sqrt(squares).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
    )


def score_with_errors(df: DataFrame, predicted_log: str = "predicted_log_salary") -> DataFrame:
    """Salary from the predicted logarithm; with actuals, log error and error in percent."""
    scored = df.withColumn("predicted_salary", F.exp(predicted_log))
    if "base_salary" not in df.columns:
        return scored
    actual = F.col("base_salary")
    return scored.withColumns({
        "actual_log_salary": F.ln(actual),
        "log_error": F.col(predicted_log) - F.ln(actual),
        "salary_error_pct": percent(F.col("predicted_salary") - actual, actual),
    })


def ranked_models(registry: DataFrame) -> DataFrame:
    """Registry rows with the first score each has, best first, rows without a score last."""
    scores = [c for c in ("test_r2", "best_cv_r2", "r2") if c in registry.columns]
    return (
        registry.withColumn("r2_score", F.coalesce(*[F.nullif(F.col(c), F.lit(0.0))
                                                     for c in scores]))
        .orderBy(F.desc_nulls_last("r2_score"), "name")
    )


def best_model(registry: DataFrame, default: str = DEFAULT_MODEL) -> DataFrame:
    """The best scored model; the default when no model has a score."""
    scored = F.col("r2_score").isNotNull()
    usable = ranked_models(registry).where(scored | (F.col("name") == default))
    return usable.orderBy(F.desc_nulls_last("r2_score"), "name").limit(1)


def leaderboard(results: DataFrame) -> DataFrame:
    """Models by test r2 with the champion flagged."""
    best = results.agg(F.max_by("model", F.struct("r2", "model"))).scalar()
    return results.withColumn("champion", F.col("model") == best).orderBy(F.desc("r2"), "model")


def prediction_interval(df: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """Predictions with a 95 % band from the deviation of all residuals."""
    half = 1.96 * df.agg(F.stddev_pop(actual - predicted)).scalar()
    return df.withColumns({"lower_bound": predicted - half, "upper_bound": predicted + half})


def error_by_range(df: DataFrame, actual: Column, predicted: Column, ranges: int = 10):
    """Mean error per equal-width range of the actual value; ranges are open on the left."""
    known = df.withColumns({"_y": actual, "_e": actual - predicted}).where("_e is not null")
    bounds = known.agg(F.struct(F.min("_y").alias("low"), F.max("_y").alias("high"))).scalar()
    placed = known.withColumn("_b", bounds)
    width = (F.col("_b.high") - F.col("_b.low")) / ranges
    place = F.greatest(F.ceil((F.col("_y") - F.col("_b.low")) / width) - 1, F.lit(0))
    return (
        placed.withColumn("salary_range", F.least(place, F.lit(ranges - 1)))
        .groupBy("salary_range")
        .agg(F.count("*").alias("records"), F.avg("_e").alias("mean_error"))
    )
