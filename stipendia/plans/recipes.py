"""Further feature and sampling recipes on the model population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipendia.functions import rules
from stipendia.functions.scalars import percent
from stipendia.operators.lookup import attach
from stipendia.operators.ranks import (
    MONEY_STEP, fold, join_on, labelled, moments_of_counts, quantiles_of_counts, value_counts,
    value_positions,
)
from stipendia.operators.tall import tall_row

STRATUM = ["work_location_borough", "title_category"]


def year_relative_salary(df: DataFrame) -> DataFrame:
    """Salary against its year. Built from the target: for reports, never a model input.

    The percentile is the mean rank of equal salaries over the size of the year.
    """
    salary, year = F.col("base_salary"), ["fiscal_year"]
    counts = value_counts(df, year, salary)
    ranks = value_positions(counts, year, MONEY_STEP).select(
        *year, F.col("_v").alias("base_salary"),
        ((F.col("_from") + F.col("_to") + 1) / 2 / F.col("_total"))
        .alias("salary_percentile_by_year"),
    )
    stats = moments_of_counts(counts, year).select(
        *year, F.col("mean").alias("_mean"), F.col("std").alias("salary_std_by_year"))
    medians = quantiles_of_counts(counts, year, {"_median": 0.5}, MONEY_STEP)
    rows = join_on(join_on(df, fold([stats, medians], year), year), ranks, [*year, "base_salary"])
    deviation = salary - F.col("_mean")
    return rows.withColumns({
        "salary_vs_year_mean": salary / F.col("_mean"),
        "salary_vs_year_median": salary / F.col("_median"),
        "salary_z_score_by_year": deviation / F.col("salary_std_by_year"),
        "salary_deviation_from_year_mean": deviation,
    }).drop("_mean", "_median")


def stratified_sample(df: DataFrame, strata: list[str], share: float, mark: Column) -> DataFrame:
    """round(share * size) rows of every stratum, those with the smallest marks.

    `mark` is a hexadecimal digest of the row, so the sample depends on the data only.
    """
    def left_out(row: Column, total: Column) -> Column:
        return F.when(row < F.bround(total * share, 0), 0).otherwise(1)

    return labelled(df, strata, mark, left_out, "_out").where("_out = 0").drop("_out")


def min_stratum(df: DataFrame, strata: list[str] = STRATUM, least: int = 100) -> DataFrame:
    """Only rows of strata with enough rows."""
    large = df.groupBy(*strata).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return attach(df, large.drop("_n"), strata, "inner")


def borough_category_cube(df: DataFrame, rare_pct: float = 0.5) -> DataFrame:
    """Borough by category with margins; cells below half a percent are rare."""
    total = F.sum(F.when(F.col("margin") == 0, F.col("records"))).over(
        Window.partitionBy(F.lit(0)))
    margin = F.grouping_id().alias("margin")
    return (
        df.cube(*STRATUM).agg(F.count("*").alias("records"), margin)
        .withColumn("pct", percent(F.col("records"), total))
        .withColumn("rare", (F.col("margin") == 0) & (F.col("pct") < rare_pct))
    )


def split_strata_report(df: DataFrame) -> DataFrame:
    """Number and sizes of the strata of each split, largest share included."""
    n = F.col("_n")
    # Strata are borough by category, so the median of their sizes is over few rows.
    return df.groupBy("split", *STRATUM).agg(F.count("*").alias("_n")).groupBy("split").agg(
        F.count("*").alias("strata"), F.median(n).alias("median_size"), F.min(n).alias("min_size"),
        F.max(n).alias("max_size"), percent(F.max(n), F.sum(n)).alias("largest_pct"),
    )


def interaction_features(df: DataFrame) -> DataFrame:
    t, size, freq = F.col("tenure_years"), F.col("agency_size"), F.col("title_frequency")
    return df.withColumns({
        "tenure_squared": t * t, "tenure_cubed": t * t * t, "tenure_x_agency_size": t * size,
        "tenure_x_title_freq": t * freq, "agency_size_x_title_freq": size * freq,
        "log_agency_size": F.log1p(size), "sqrt_tenure": F.sqrt(t),
    })


def job_seniority(df: DataFrame) -> DataFrame:
    return df.withColumn("job_seniority", rules.job_seniority(F.col("title_std")))


def borough_cola(df: DataFrame) -> DataFrame:
    factor = rules.lookup(F.upper("work_location_borough"), rules.BOROUGH_COST)
    return df.withColumn("borough_cola", factor)


def agency_prestige(df: DataFrame) -> DataFrame:
    """Rank of the agency's mean salary over the number of agencies; ties share a mean rank."""
    means = df.groupBy("agency_std").agg(F.avg("base_salary").alias("mean_salary"))
    everything = Window.partitionBy(F.lit(0))
    ties = F.count("*").over(Window.partitionBy("mean_salary"))
    rank = F.rank().over(everything.orderBy("mean_salary")) + (ties - 1) / 2
    return means.withColumn("agency_prestige", rank / F.count("*").over(everything))


# Fixed value: features whose variance is not above this are dropped.
LEAST_VARIANCE = 0.01


def variance_report(df: DataFrame, columns: list[str],
                    threshold: float = LEAST_VARIANCE) -> DataFrame:
    """Population variance per feature and whether it passes the threshold."""
    row = df.agg(*[F.var_pop(c).alias(f"{c}__variance") for c in columns])
    return tall_row(row, columns, ["variance"]).withColumn(
        "kept", F.col("variance") > threshold)


def drop_constant(df: DataFrame, columns: list[str],
                  threshold: float = LEAST_VARIANCE) -> DataFrame:
    """The table without the features that do not vary enough; one row a column comes back."""
    report = variance_report(df, columns, threshold).where("not kept")
    return df.drop(*[r.column_name for r in report.select("column_name").collect()])
