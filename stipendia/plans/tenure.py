"""Tenure marts. Input: the analysis population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipendia.functions.buckets import (
    CAREER_TENURE, ML_TENURE, REPORT_TENURE, bucket, position, report_tenure,
)
from stipendia.functions.scalars import clip, count_where, log_salary, percent, true
from stipendia.operators.histogram import histogram
from stipendia.operators.ranks import MONEY_STEP, YEARS_STEP, quantiles, summarize, value_counts
from stipendia.operators.tall import tall_row

CAP = 35.0


def with_tenure(population: DataFrame) -> DataFrame:
    """Capped tenure and its report bucket."""
    capped = population.withColumn("tenure_capped", clip(F.col("employee_agency_tenure"),
                                                         high=CAP))
    return capped.withColumn("tenure_bucket_simple", report_tenure(F.col("tenure_capped")))


def with_ml_tenure(population: DataFrame) -> DataFrame:
    """Tenure features for models; a missing tenure has no seniority flag."""
    t = F.col("tenure_capped")

    def flag(c: Column) -> Column:
        return true(c).cast("int")

    opening = F.lit("2015-01-01").cast("date")
    return with_tenure(population).withColumns({
        "tenure_years_raw": t, "tenure_log": F.log1p(t), "tenure_squared": t * t,
        "tenure_bucket_ml": bucket(t, ML_TENURE),
        "is_senior": flag(t >= 10), "is_mid_career": flag((t >= 4) & (t < 10)),
        "is_early_career": flag(t < 4),
        "years_since_2015": clip(F.date_diff(opening, F.col("agency_start_date")) / 365.25, 0.0),
    })


def tenure_quality(population: DataFrame) -> DataFrame:
    t, start = F.col("employee_agency_tenure"), F.col("agency_start_date")
    return summarize(
        population, [],
        [
            F.min(t).alias("min_years"), F.max(t).alias("max_years"), F.avg(t).alias("mean_years"),
            F.stddev(t).alias("std_years"), count_where(t.isNull()).alias("missing"),
            count_where(t < 0).alias("negative"), count_where(t == 0).alias("zero"),
            count_where(t > 50).alias("over_50"), count_where(t > CAP).alias("capped"),
            F.min(start).alias("first_start"), F.max(start).alias("last_start"),
            count_where(start.isNull()).alias("missing_start"),
        ],
        (t, {"median_years": 0.5}, YEARS_STEP),
    )


def tenure_validation(population: DataFrame) -> DataFrame:
    """Correlation of tenure with years from start to the end of the last year.

    A common end date shifts all values alike, so days since 1970 serve as well; the mean
    takes the end date from the same pass.
    """
    t = F.col("employee_agency_tenure")
    days = F.unix_date("agency_start_date").cast("double")
    end = F.unix_date(F.make_date(F.max("fiscal_year"), F.lit(12), F.lit(31)))
    return population.agg(
        F.corr(t, -days).alias("correlation"),
        ((end - F.avg(days)) / 365.25).alias("mean_calculated_tenure"),
    )


def _by_bucket(population: DataFrame, *aggregates: Column) -> DataFrame:
    known = with_tenure(population).where("tenure_bucket_simple is not null")
    return known.groupBy("tenure_bucket_simple").agg(*aggregates)


def tenure_buckets(population: DataFrame) -> DataFrame:
    """Records per bucket; the share counts records without tenure, too."""
    counts = with_tenure(population).groupBy("tenure_bucket_simple").agg(
        F.count("*").alias("records"))
    total = F.sum("records").over(Window.partitionBy(F.lit(0)))
    return (
        counts.withColumn("pct", percent(F.col("records"), total))
        .where("tenure_bucket_simple is not null")
    )


def _new_hires(population: DataFrame) -> DataFrame:
    return with_tenure(population).where("tenure_capped < 0.5")


def new_hires(population: DataFrame) -> DataFrame:
    return _new_hires(population).agg(
        F.count("*").alias("new_hires"), F.avg("base_salary").alias("avg_salary"))


def new_hire_agencies(population: DataFrame, top: int = 5) -> DataFrame:
    return (
        _new_hires(population).where("agency_name is not null").groupBy("agency_name")
        .agg(F.count("*").alias("new_hires"))
        .orderBy(F.desc("new_hires"), "agency_name").limit(top)
    )


def salary_by_tenure(population: DataFrame) -> DataFrame:
    salary = F.col("base_salary")
    return summarize(
        with_tenure(population).where("tenure_bucket_simple is not null"),
        ["tenure_bucket_simple"],
        [F.avg(salary).alias("mean"), F.stddev(salary).alias("std"),
         F.count(salary).alias("count")],
        (salary, {"median": 0.5}, MONEY_STEP),
    )


def tenure_progression(population: DataFrame) -> DataFrame:
    """Change of the mean salary from bucket to bucket, and the running sum of the changes."""
    means = _by_bucket(population, F.avg("base_salary").alias("mean_salary"))
    order = Window.partitionBy(F.lit(0)).orderBy("bucket_order")
    previous = F.lag("mean_salary").over(order)
    return (
        means.withColumn("bucket_order", position(F.col("tenure_bucket_simple"), REPORT_TENURE))
        .withColumn("change", F.col("mean_salary") - previous)
        .withColumn("change_pct", percent(F.col("change"), previous))
        .withColumn("cumulative_pct", F.sum("change_pct").over(
            order.rowsBetween(Window.unboundedPreceding, 0)))
        .where("change is not null")
    )


def career_stage(population: DataFrame) -> DataFrame:
    labels, bucket_of = REPORT_TENURE[1], F.col("tenure_bucket_simple")

    def mean(part: list[str]) -> Column:
        return F.avg(F.when(bucket_of.isin(part), F.col("base_salary")))

    early, mid, senior = mean(labels[:2]), mean(labels[2:4]), mean(labels[4:])
    return with_tenure(population).agg(
        early.alias("early_career"), mid.alias("mid_career"), senior.alias("senior_career"),
        percent(mid - early, early).alias("mid_uplift_pct"),
        percent(senior - early, early).alias("senior_uplift_pct"),
    )


def pay_by_tenure(population: DataFrame) -> DataFrame:
    means = _by_bucket(population, F.avg("total_ot_paid").alias("avg_ot"),
                       F.avg("total_other_pay").alias("avg_other"))
    return means.withColumn("avg_combined", F.col("avg_ot") + F.col("avg_other"))


def tenure_linear_fit(population: DataFrame) -> DataFrame:
    y, x = F.col("base_salary"), F.col("tenure_capped")
    return with_tenure(population).where(x <= CAP).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )


def tenure_correlations(population: DataFrame) -> DataFrame:
    """Correlation of each tenure feature with the salary and its logarithm."""
    features = ["tenure_years_raw", "tenure_log", "tenure_squared", "years_since_2015"]
    salary = F.col("base_salary")
    targets = {"log_base_salary": log_salary(salary), "base_salary": salary}
    row = with_ml_tenure(population).agg(
        *[F.corr(F.col(f), c).alias(f"{f}__{t}") for f in features for t, c in targets.items()]
    )
    return tall_row(row, features, list(targets)).withColumnRenamed("column_name", "feature")


def _agency_tenure(population: DataFrame) -> DataFrame:
    capped = F.col("tenure_capped")
    means = summarize(
        with_tenure(population).where("agency_name is not null"), ["agency_name"],
        [F.avg(capped).alias("mean_tenure"), F.count(capped).alias("employees")],
        (capped, {"median_tenure": 0.5}, YEARS_STEP),
    )
    return means.withColumn("mean_tenure", F.round("mean_tenure", 1))


def tenure_agency_extremes(population: DataFrame, least: int = 100, top: int = 10) -> DataFrame:
    """Agencies with the highest and the lowest mean tenure, small agencies left out."""
    large = _agency_tenure(population).where(F.col("employees") >= least)

    def end(name: str, order: Column) -> DataFrame:
        return large.orderBy(order, "agency_name").limit(top).withColumn("extreme", F.lit(name))

    return end("highest", F.desc("mean_tenure")).unionByName(end("lowest", F.asc("mean_tenure")))


def tenure_by_category(population: DataFrame) -> DataFrame:
    capped = F.col("tenure_capped")
    return summarize(
        with_tenure(population), ["title_category"],
        [F.avg(capped).alias("mean_tenure"), F.count(capped).alias("employees")],
        (capped, {"median_tenure": 0.5}, YEARS_STEP),
    )


def senior_share(population: DataFrame) -> DataFrame:
    return with_tenure(population).agg(
        percent(count_where(F.col("tenure_capped") > 10), F.count("*")).alias("pct_over_10_years"))


def salary_band_by_tenure(population: DataFrame) -> DataFrame:
    """Mean salary with the 2.5 % and 97.5 % quantiles per bucket."""
    salary = F.col("base_salary")
    return summarize(
        with_tenure(population).where("tenure_bucket_simple is not null"),
        ["tenure_bucket_simple"], [F.avg(salary).alias("mean_salary")],
        (salary, {"lower": 0.025, "upper": 0.975}, MONEY_STEP),
    )


def tenure_category_heatmap(population: DataFrame, top: int = 8) -> DataFrame:
    """Mean salary per career group and title category, for the most common categories.

    Sums and counts per cell are enough to rank the categories, so one pass does both.
    """
    grouped = with_tenure(population).withColumn(
        "tenure_group", bucket(F.col("tenure_capped"), CAREER_TENURE))
    cells = grouped.groupBy("tenure_group", "title_category").agg(
        F.avg("base_salary").alias("avg_salary"), F.count("*").alias("_n"))
    common = Window.partitionBy(F.lit(0)).orderBy(F.desc("_records"), "title_category")
    return (
        cells.withColumn("_records", F.sum("_n").over(Window.partitionBy("title_category")))
        .withColumn("_place", F.dense_rank().over(common))
        .where((F.col("_place") <= top) & F.col("tenure_group").isNotNull())
        .select("tenure_group", "title_category", F.round("avg_salary", 0).alias("avg_salary"))
    )


_MASTER = [
    "agency_name", "title_description", "title_category", "title_std", "agency_std",
    "employee_agency_tenure", "tenure_capped", "tenure_bucket_simple", "tenure_bucket_ml",
    "is_senior", "is_mid_career", "is_early_career", "base_salary", "total_ot_paid",
    "total_compensation", "fiscal_year", "employment_type", "hours_tracked",
]


def tenure_master(population: DataFrame) -> DataFrame:
    """The tenure table for dashboards: 18 columns without gaps and four derived ones."""
    unknown = ["employment_type", "agency_name", "title_description", "title_category",
               "title_std", "agency_std"]
    zero = ["tenure_capped", "base_salary", "total_ot_paid", "total_compensation", "fiscal_year"]
    base, ot = F.col("base_salary"), F.col("total_ot_paid")
    return (
        with_ml_tenure(population).select(*_MASTER)
        .na.fill({**dict.fromkeys(unknown, "Unknown"), **dict.fromkeys(zero, 0),
                  "tenure_bucket_simple": REPORT_TENURE[1][0], "tenure_bucket_ml": "0",
                  "hours_tracked": False})
        .withColumns({
            "salary_k": base / 1000, "tenure_years": F.col("tenure_capped").cast("int"),
            "total_pay": base + ot, "other_pay": F.col("total_compensation") - base - ot,
        })
    )


def tenure_histogram(population: DataFrame, bins: int = 50) -> DataFrame:
    counts = value_counts(with_tenure(population), [], F.col("tenure_capped"))
    return histogram(counts.withColumn("column_name", F.lit("tenure_capped")), ["column_name"],
                     bins, YEARS_STEP)


def tenure_percentiles(population: DataFrame) -> DataFrame:
    marks = {f"p{p}": p / 100 for p in (25, 50, 75, 90)}
    return quantiles(with_tenure(population), [], F.col("tenure_capped"), marks, YEARS_STEP)
