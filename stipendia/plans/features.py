"""Model population, features, reference table and yearly panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipendia import session
from stipendia.functions.buckets import MODEL_TENURE, bucket
from stipendia.functions.scalars import clean_text, clip, log_salary, title_case, to_double
from stipendia.operators.lookup import attach
from stipendia.operators.ranks import MONEY_STEP, join_on, quantiles, summarize
from stipendia.schema import (
    CATEGORICAL_FEATURES, MAX_BASE_SALARY, MIN_BASE_SALARY, NUMERIC_FEATURES, POPULATION_COLUMNS,
    TEST_YEARS, TRAIN_YEARS, VALID_YEARS,
)

PAIR = ["agency_std", "title_std"]
CELL = [*PAIR, "fiscal_year"]
HOURS_STEP = 100.0
OTHER_TITLE, MIN_TITLE_COUNT = "other_title", 100


def model_population(df: DataFrame) -> DataFrame:
    """Rows with a plausible salary, clean text, no repeats; only wanted columns that exist.

    Names are dropped before repeats are removed, so equally paid colleagues become one row.
    """
    text = {"agency_std", "title_std", "title_category", "work_location_borough"}
    numeric = {"base_salary", "regular_hours"}

    def shaped(name: str) -> Column:
        c = F.col(name)
        if name in text:
            c = clean_text(c)
        elif name in numeric:
            c = to_double(c)
        elif name == "fiscal_year":
            c = c.try_cast("int")
        return c.alias(name)

    kept = df.select(*[shaped(c) for c in POPULATION_COLUMNS if c in df.columns])
    return kept.where(F.col("base_salary").between(MIN_BASE_SALARY, MAX_BASE_SALARY)).distinct()


def with_split(df: DataFrame) -> DataFrame:
    """Train, valid or test by fiscal year; other years are dropped."""
    year = F.col("fiscal_year")
    chain = F
    for name, years in (("train", TRAIN_YEARS), ("valid", VALID_YEARS), ("test", TEST_YEARS)):
        chain = chain.when(year.isin(list(years)), F.lit(name))
    return df.withColumn("split", chain).where("split is not null")


def temporal_split(df: DataFrame) -> DataFrame:
    return with_split(df).groupBy("split").agg(
        F.count("*").alias("records"), F.min("fiscal_year").alias("first_year"),
        F.max("fiscal_year").alias("last_year"),
    )


def cell_features(df: DataFrame) -> DataFrame:
    """Every feature that depends on (agency, title, year) only, one row per such cell.

    One pass counts the cells; the windows then run over cells, never over records, so a
    frequent title costs no more than a rare one.
    """
    cells = df.groupBy(*CELL).agg(F.count("*").alias("_n"))
    first = F.min("fiscal_year").over(Window.partitionBy(*PAIR))
    size = F.sum("_n")
    by_title, by_agency = (Window.partitionBy("split", k) for k in ("title_std", "agency_std"))
    return (
        cells.withColumn("tenure_years", clip(F.col("fiscal_year") - first, 0))
        .transform(with_split)
        .withColumns({
            "tenure_bucket": F.coalesce(bucket(F.col("tenure_years"), MODEL_TENURE), F.lit("nan")),
            "title_frequency": size.over(by_title),
            "agency_size": size.over(by_agency),
        })
        .withColumn("title_std_grouped", F.when(
            F.col("title_frequency") >= MIN_TITLE_COUNT, F.col("title_std")).otherwise(OTHER_TITLE))
        .drop("_n")
    )


def _with_cells(df: DataFrame, *columns: str) -> DataFrame:
    """Records with features of their cells. Cells are written before the join, so their size is known when
    it is planned: records are shuffled only where the cells are too many to be broadcast."""
    found = session.written(cell_features(df).select(*CELL, *columns), "cells")
    return attach(df, found, CELL, "inner")


def tenure_proxy(df: DataFrame) -> DataFrame:
    """Years since the first year in which the agency had the title; 0 without these columns."""
    if not set(CELL) <= set(df.columns):
        return df.withColumn("tenure_years", F.lit(0))
    first = df.groupBy(*PAIR).agg(F.min("fiscal_year").alias("_first"))
    return (
        attach(df, first, PAIR)
        .withColumn("tenure_years", clip(F.col("fiscal_year") - F.col("_first"), 0)).drop("_first")
    )


def frequency_features(df: DataFrame) -> DataFrame:
    """Records of the same title and of the same agency within the split."""
    return _with_cells(df, "split", "title_frequency", "agency_size")


def rare_titles(df: DataFrame) -> DataFrame:
    """Titles with fewer than 100 records in their split become one group."""
    return _with_cells(df, "split", "title_std_grouped")


def with_overtime_features(df: DataFrame) -> DataFrame:
    if "ot_hours" not in df.columns:
        return df
    total = F.coalesce("ot_hours", F.lit(0.0))
    return df.withColumns({"ot_hours_total": total, "has_ot": (total > 0).cast("int")})


def feature_table(df: DataFrame) -> DataFrame:
    """Model population with split, target and all engineered features, in one join."""
    extra = ["split", "tenure_years", "tenure_bucket", "title_std_grouped", "title_frequency",
             "agency_size"]
    salary = log_salary(F.col("base_salary"))
    return _with_cells(df, *extra).withColumn("log_base_salary", salary)


def split_of(features: DataFrame, name: str) -> DataFrame:
    return features.where(F.col("split") == name)


def reference_table(df: DataFrame, year: int | None = None) -> DataFrame:
    """Salary and size statistics per (agency, title) of one year, by default the last."""
    wanted = F.lit(year) if year is not None else df.agg(F.max("fiscal_year")).scalar()
    current = df.where(F.col("fiscal_year") == wanted)
    salary, median = F.col("base_salary"), 0.5
    pairs = summarize(
        current, PAIR,
        [F.count("*").alias("agency_title_count"), F.max("fiscal_year").alias("current_year")],
        (F.col("regular_hours"), {"regular_hours": median}, HOURS_STEP),
    )
    titles = summarize(
        current, ["title_std"], [F.count("*").alias("count_of_job_titles")],
        (salary, {"median_salary_by_title": median}, MONEY_STEP),
    )
    agencies = quantiles(current, ["agency_std"], salary, {"median_salary_by_agency": median})
    return join_on(join_on(pairs, titles, ["title_std"]), agencies, ["agency_std"])


def with_reference(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Left join; the lookup's hours keep a name of their own."""
    lookup = reference.withColumnRenamed("regular_hours", "ref_regular_hours")
    return join_on(df, lookup, PAIR)


def training_table(population: DataFrame) -> DataFrame:
    """Features of all splits joined to the reference table of the training years."""
    features = feature_table(population)
    return with_reference(features, reference_table(split_of(features, "train")))


def yoy_summary(features: DataFrame) -> DataFrame:
    """Median salary, headcount and median hours per year, title and agency."""
    salary = F.col("base_salary")
    return summarize(
        features.dropna(subset=CELL), ["fiscal_year", "title_std", "agency_std"],
        [F.count(salary).alias("headcount")],
        (salary, {"base_salary": 0.5}, MONEY_STEP),
        (F.col("regular_hours"), {"regular_hours": 0.5}, HOURS_STEP),
    )


def title_category_map(train: DataFrame) -> DataFrame:
    """The most frequent category per title; the first in order wins a tie.

    Categories are counted before titles meet, so no task sees all rows of a title.
    """
    counts = (
        train.dropna(subset=["title_std", "title_category"])
        .groupBy("title_std", "title_category").agg(F.count("*").alias("_n"))
    )
    most = F.min_by("title_category", F.struct(-F.col("_n"), F.col("title_category")))
    return counts.groupBy("title_std").agg(most.alias("title_category"))


def title_agency_totals(reference: DataFrame) -> DataFrame:
    """Records per title and per agency of the reference year."""
    sides = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(c).alias("key"))
        for kind, c in (("title", "title_std"), ("agency", "agency_std"))
    ])).alias("side")
    return (
        reference.select("agency_title_count", sides).groupBy("side.kind", "side.key")
        .agg(F.sum("agency_title_count").alias("records"))
    )


def title_to_agencies(reference: DataFrame) -> DataFrame:
    """Display title to the sorted list of display agencies."""
    names = reference.select(title_case(F.col("title_std")).alias("title"),
                             title_case(F.col("agency_std")).alias("agency"))
    return names.groupBy("title").agg(F.sort_array(F.collect_set("agency")).alias("agencies"))


def model_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Categorical and numeric inputs that the table has.

    A table joined to the reference has two columns of hours, so neither is an input.
    """
    both = "ref_regular_hours" in df.columns
    numeric = [c for c in NUMERIC_FEATURES
               if c in df.columns and not (both and c == "regular_hours")]
    return [c for c in CATEGORICAL_FEATURES if c in df.columns], numeric
