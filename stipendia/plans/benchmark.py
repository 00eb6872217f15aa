"""Salary benchmarks for a table of requests (request_id, title, agency, tenure_years)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipendia.functions.buckets import MODEL_TENURE, bucket
from stipendia.functions.scalars import clean_text, percent
from stipendia.operators.histogram import nice_width
from stipendia.operators.lookup import attach
from stipendia.operators.ranks import join_on
from stipendia.plans.features import MIN_TITLE_COUNT, OTHER_TITLE, PAIR

# Prediction year, fallbacks and the blend of model and history.
YEAR, HORIZON = 2024, 5
DEFAULT_COUNT, DEFAULT_HOURS, DEFAULT_YEAR, DEFAULT_CATEGORY = 1, 1820.0, 2022, "other"
DEFAULT_GROWTH, DEFAULT_SPREAD = 0.02, 0.10
MODEL_SHARE, HISTORY_SHARE = 0.70, 0.30
TENURE_LIMIT, WEEKLY_HOURS, PAY_BASIS = 20, 40, "annual"


def normalised(requests: DataFrame) -> DataFrame:
    return requests.withColumns({"title_std": clean_text(F.col("title")),
                                 "agency_std": clean_text(F.col("agency"))})


def requests_without_reference(requests: DataFrame, reference: DataFrame) -> DataFrame:
    pairs = reference.select(*PAIR)
    return normalised(requests).join(pairs, PAIR, "left_anti").select("request_id", *PAIR)


def benchmark_requests(requests: DataFrame, reference: DataFrame, categories: DataFrame):
    """The model input row of every request whose (title, agency) has reference data."""
    def total(key: str) -> DataFrame:
        return reference.groupBy(key).agg(F.sum("agency_title_count").alias(f"_{key}"))

    found = join_on(normalised(requests), reference, PAIR, "inner")
    found = join_on(found, total("title_std"), ["title_std"])
    found = join_on(found, total("agency_std"), ["agency_std"])
    found = join_on(found, categories, ["title_std"])

    def or_else(name: str, value) -> Column:
        return F.coalesce(name, F.lit(value))

    return found.select(
        "request_id", *PAIR,
        or_else("title_category", DEFAULT_CATEGORY).alias("title_category"),
        F.when(F.col("agency_title_count") >= MIN_TITLE_COUNT, F.col("title_std"))
        .otherwise(OTHER_TITLE).alias("title_std_grouped"),
        bucket(F.col("tenure_years"), MODEL_TENURE).alias("tenure_bucket"),
        F.lit(YEAR).alias("fiscal_year"), F.col("tenure_years").cast("int"),
        F.coalesce("_title_std", "agency_title_count").alias("title_frequency"),
        or_else("_agency_std", DEFAULT_COUNT).alias("agency_size"),
        "agency_title_count", "median_salary_by_title", "median_salary_by_agency",
        or_else("count_of_job_titles", DEFAULT_COUNT).alias("count_of_job_titles"),
        or_else("current_year", DEFAULT_YEAR).alias("current_year"),
        or_else("regular_hours", DEFAULT_HOURS).alias("regular_hours"),
        F.col("median_salary_by_title").alias("title_avg_salary"),
    )


def yoy_growth(inputs: DataFrame, panel: DataFrame) -> DataFrame:
    """Growth in percent from the year before the last to the last year, per request.

    Titles compare the medians of their agency medians. Null when a year is missing or the
    earlier value is zero.
    """
    newest = panel.agg(F.max("fiscal_year")).scalar()
    recent = panel.withColumn("_age", newest - F.col("fiscal_year")).where(
        F.col("_age").isin(0, 1))

    def growth(metric: Column, pick) -> Column:
        now, before = (pick(F.when(F.col("_age") == age, metric)) for age in (0, 1))
        return percent(now - before, before)

    # A title has at most one panel row per agency and year, so its median is cheap.
    titles = recent.groupBy("title_std").agg(
        growth(F.col("base_salary"), F.median).alias("title_growth"))
    pairs = recent.groupBy(*PAIR).agg(
        growth(F.col("base_salary"), F.max).alias("agency_growth"),
        growth(F.col("headcount"), F.max).alias("headcount_growth"),
        growth(F.col("regular_hours"), F.max).alias("hours_growth"),
    )
    asked = inputs.select("request_id", *PAIR)
    return join_on(join_on(asked, titles, ["title_std"]), pairs, PAIR)


def salary_cagr(panel: DataFrame) -> DataFrame:
    """Average yearly growth, number of points and sample deviation per (agency, title)."""
    year, salary = F.col("fiscal_year"), F.col("base_salary")
    span = F.max(year) - F.min(year)
    rate = F.pow(
        F.try_divide(F.max_by(salary, year), F.min_by(salary, year)),
        F.try_divide(F.lit(1.0), span),
    ) - 1
    return panel.groupBy(*PAIR).agg(
        F.count("*").alias("points"),
        F.when((F.count("*") >= 2) & (span > 0), rate).otherwise(DEFAULT_GROWTH).alias("growth"),
        F.stddev(salary).alias("deviation"),
    )


def blended(model: Column, history: Column) -> Column:
    """70 % model and 30 % history; the model alone where there is no history."""
    return F.coalesce(MODEL_SHARE * model + HISTORY_SHARE * history, model)


def salary_trajectory(inputs: DataFrame, panel: DataFrame, predicted: Column | None = None):
    """History, prediction for this year and five projected years with a widening band.

    `predicted` is a column of the inputs; without a model it is the median of the title.
    """
    estimate = F.col("median_salary_by_title") if predicted is None else predicted
    asked = inputs.select("request_id", *PAIR, estimate.alias("_now"))
    history = join_on(asked, panel, PAIR, "inner").select(
        "request_id", "fiscal_year", F.col("base_salary").alias("salary"),
        F.lit("Historical Median").alias("kind"),
    )
    known = F.col("points") >= 2
    trend = join_on(asked, salary_cagr(panel), PAIR).withColumns({
        "_growth": F.coalesce("growth", F.lit(DEFAULT_GROWTH)),
        "_spread": F.when(known, F.col("deviation")).otherwise(F.col("_now") * DEFAULT_SPREAD),
        "_ahead": F.explode(F.sequence(F.lit(0), F.lit(HORIZON))),
    })
    ahead, now = F.col("_ahead"), F.col("_now")
    salary = now * F.pow(F.col("_growth") + 1, ahead)
    spread = F.col("_spread") * F.sqrt(ahead)
    projected = trend.select(
        "request_id", (ahead + YEAR).alias("fiscal_year"), salary.alias("salary"),
        F.lit("Projected").alias("kind"), (salary - spread).alias("lower"),
        (salary + spread).alias("upper"),
    )
    return history.unionByName(projected, allowMissingColumns=True)


def median_histogram(reference: DataFrame, title: str, bins: int = 40) -> DataFrame:
    """Roles per salary bin of a round width, with the bin of one title marked."""
    salary = F.col("median_salary_by_title")
    span = reference.agg(F.max(salary) - F.min(salary)).scalar()
    binned = reference.where(salary.isNotNull()).withColumn("_width", nice_width(span, bins))
    low = F.floor(salary / F.col("_width")) * F.col("_width")
    return (
        binned.groupBy(low.alias("bin_low"), (low + F.col("_width")).alias("bin_high"))
        .agg(F.count("*").alias("roles"), F.max(F.col("title_std") == title).alias("selected"))
    )


def guarded(df: DataFrame) -> DataFrame:
    """Limits and defaults put on inputs before scoring."""
    tenure = F.least(F.col("tenure_years"), F.lit(TENURE_LIMIT))
    out = df.withColumn("tenure_years", F.when(F.col("tenure_years").isNotNull(), tenure))
    defaults = {"regular_hours_worked": WEEKLY_HOURS, "pay_basis": PAY_BASIS}
    return out.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def blended_prediction(df: DataFrame, model: Column, title_history: DataFrame) -> DataFrame:
    """Final salary per row from a model value and the mean salary of the title.

    `title_history` has title_std and title_avg_salary.
    """
    rows = attach(guarded(df).withColumn("_model", model), title_history, ["title_std"])
    history = F.col("title_avg_salary")
    return rows.withColumns({
        "expected_salary": F.round(blended(F.col("_model"), history), 2),
        "historical_median": F.round(F.coalesce(history, F.lit(0.0)), 2),
        "model_prediction_raw": F.round("_model", 2),
    }).drop("_model", "title_avg_salary")
