"""Boroughs, headcount over time, effect of standard names, low compensation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipendia.functions import rules
from stipendia.functions.buckets import LOW_COMP_HOURS, bucket
from stipendia.functions.scalars import count_where, percent
from stipendia.plans import profile
from stipendia.plans.clean import STATUS, annual, with_total_compensation
from stipendia.plans.overtime import EDUCATION

OFFICIAL = sorted(set(rules.BOROUGHS.values()))

# Shown examples of standard titles.
TITLE_EXAMPLES = {
    "Annual Ed Para": "Para-Professional",
    "Teacher Special Education": "Special Education Teacher",
    "P.O. Da Det Gr3": "Police Detective Grade 3",
    "Sergeant-": "Police Sergeant",
    "Emergency Medical Specialist-Emt": "Emergency Medical Specialist",
    "Caretaker": "Maintenance Worker",
}


def _total(count: str) -> Column:
    return F.sum(count).over(Window.partitionBy(F.lit(0)))


def borough_clean(raw: DataFrame) -> DataFrame:
    """Active records per borough spelling and the official borough it maps to (null: dropped)."""
    return (
        raw.distinct().where(F.col(STATUS) == "ACTIVE")
        .groupBy(F.coalesce("work_location_borough", F.lit("UNKNOWN")).alias("spelling"))
        .agg(F.count("*").alias("records"))
        .withColumn("borough", rules.official_borough(F.col("spelling")))
        .withColumn("pct", percent(F.col("records"), _total("records")))
    )


def borough_share(raw: DataFrame, year: int = 2014, top: int = 10) -> DataFrame:
    """Largest work locations of one year; the share counts records without one, too."""
    in_year = raw.where(F.col("fiscal_year") == year)
    places = profile.value_shares(in_year, "work_location_borough")
    return places.where("value is not null").orderBy(F.desc("n"), "value").limit(top)


def borough_year_pivot(standard: DataFrame) -> DataFrame:
    counts = annual(standard).groupBy("fiscal_year").pivot("work_location_borough", OFFICIAL)
    filled = counts.count().na.fill(0)
    return filled.toDF("fiscal_year", *[b.lower().replace(" ", "_") for b in OFFICIAL])


def workforce_by_year(clean: DataFrame) -> DataFrame:
    return clean.groupBy("fiscal_year").agg(F.count("*").alias("employees"))


def workforce_trend(clean: DataFrame) -> DataFrame:
    """Peak, low, growth over all years, the 2019 to 2020 change, last against fourth-last year."""
    year, n = F.col("fiscal_year"), F.col("employees")
    in_order = F.sort_array(F.collect_list(F.struct(year, n)))
    first, last = F.min_by(n, year), F.max_by(n, year)

    def of(y: int) -> Column:
        return F.max(F.when(year == y, n))

    return workforce_by_year(clean).agg(
        F.max(n).alias("peak"), F.max_by(year, F.struct(n, -year)).alias("peak_year"),
        F.min(n).alias("low"), F.min_by(year, F.struct(n, year)).alias("low_year"),
        percent(last - first, first).alias("growth_pct"), F.avg(n).alias("average"),
        of(2019).alias("employees_2019"), of(2020).alias("employees_2020"),
        (F.abs(of(2020) - of(2019)) > 10_000).alias("pandemic_noticeable"),
        (last > F.try_element_at(in_order, F.lit(-4)).employees).alias("recent_growth"),
    )


def standardization_effect(standard: DataFrame) -> DataFrame:
    """Distinct names before and after standardisation, reduction in percent."""
    columns = ["agency_name", "agency_std", "title_description", "title_std", "title_category"]
    counts = profile.cardinality_profile(standard, columns)

    def distinct(column: str) -> Column:
        return F.max(F.when(F.col("column_name") == column, F.col("distinct_values")))

    def reduction(before: str, after: str) -> Column:
        return percent(distinct(before) - distinct(after), distinct(before))

    return counts.agg(
        distinct("agency_name").alias("agencies_before"),
        distinct("agency_std").alias("agencies_after"),
        distinct("title_description").alias("titles_before"),
        distinct("title_std").alias("titles_after"),
        distinct("title_category").alias("categories"),
        reduction("agency_name", "agency_std").alias("agency_reduction_pct"),
        reduction("title_description", "title_std").alias("title_reduction_pct"),
    )


def title_examples(standard: DataFrame, examples: dict[str, str] = TITLE_EXAMPLES) -> DataFrame:
    """Records that carry the original title, and records that carry the standard one."""
    counts = standard.agg(*[
        F.struct(
            F.lit(before).alias("original"), F.lit(after).alias("standard"),
            count_where(F.col("title_description") == before).alias("original_records"),
            count_where(F.col("title_std") == after).alias("standard_records"),
        ).alias(f"e{i}") for i, (before, after) in enumerate(examples.items())
    ])
    rows = F.explode(F.array(*counts.columns)).alias("e")
    return counts.select(rows).select("e.*")


def title_search(standard: DataFrame, title: str = "president") -> DataFrame:
    return standard.where(F.lower("title_std") == title)


def _data_sets(population: DataFrame) -> DataFrame:
    """Each record once per data set it belongs to."""
    tracked = F.col("hours_tracked")
    names = F.array_compact(F.array(
        F.lit("combined"), F.when(tracked, "hourly").otherwise("salaried"),
        F.when(tracked & (F.col("agency_std") != EDUCATION), "hourly_without_doe"),
    ))
    return population.withColumn("data_set", F.explode(names))


def borough_distribution(population: DataFrame) -> DataFrame:
    """Records and share per borough of all, hourly, salaried, and hourly non-education staff."""
    total = F.sum("records").over(Window.partitionBy("data_set"))
    return (
        _data_sets(population)
        .groupBy("data_set", F.coalesce("work_location_borough", F.lit("UNKNOWN/NaN"))
                 .alias("borough"))
        .agg(F.count("*").alias("records"))
        .withColumn("pct", F.round(percent(F.col("records"), total), 2))
    )


def borough_hourly_vs_salaried(population: DataFrame) -> DataFrame:
    """Share of each borough in both kinds of staff; flagged when more than 5 points apart."""
    tracked = F.col("hours_tracked")
    counts = population.groupBy("work_location_borough").agg(
        count_where(~tracked).alias("salaried"), count_where(tracked).alias("hourly"))
    return (
        counts
        .withColumn("salaried_pct", F.round(percent(F.col("salaried"), _total("salaried")), 2))
        .withColumn("hourly_pct", F.round(percent(F.col("hourly"), _total("hourly")), 2))
        .withColumn("difference", F.col("hourly_pct") - F.col("salaried_pct"))
        .withColumn("flagged", F.abs("difference") > 5)
        .where("work_location_borough is not null").drop("salaried", "hourly")
    )


def low_comp(clean: DataFrame) -> DataFrame:
    """Records whose total compensation is below half the base salary."""
    half = F.col("base_salary") * 0.5
    return with_total_compensation(clean).where(F.col("total_compensation") < half)


def low_comp_share(clean: DataFrame) -> DataFrame:
    low = F.col("total_compensation") < F.col("base_salary") * 0.5
    return with_total_compensation(clean).agg(
        count_where(low).alias("records"),
        percent(count_where(low), F.count("*")).alias("pct"),
    )


def low_comp_profile(clean: DataFrame) -> DataFrame:
    columns = ["base_salary", "regular_gross_paid", "total_ot_paid", "total_other_pay",
               "total_compensation", "regular_hours"]
    return profile.numeric_profile(low_comp(clean), columns)


def hours_buckets(clean: DataFrame) -> DataFrame:
    """Low-compensation records per band of regular hours."""
    banded = low_comp(clean).withColumn("hours_bucket", bucket(F.col("regular_hours"),
                                                               LOW_COMP_HOURS))
    return (
        banded.where("hours_bucket is not null").groupBy("hours_bucket")
        .agg(F.count("*").alias("records"))
    )
