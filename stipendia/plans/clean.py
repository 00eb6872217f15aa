"""Raw payroll records to clean records and to the analysis population."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipendia.functions import rules
from stipendia.functions.buckets import EMPLOYMENT_HOURS, bucket
from stipendia.functions.scalars import parsed_date, plausible_date, tenure_at_june_30, true
from stipendia.schema import FIRST_YEAR, LAST_YEAR, PAY_COLUMNS

STATUS = "leave_status_as_of_june_30"


def located(raw: DataFrame) -> DataFrame:
    """Active staff of an official borough, with parsed start dates; others are dropped.

    The borough filter names the accepted spellings, so that it reaches the scan. The date is
    parsed in a step of its own, because its bounds refer to it more than once.
    """
    date = "agency_start_date"
    borough = F.col("work_location_borough")
    return (
        raw.where((F.col(STATUS) == "ACTIVE") & borough.isin(list(rules.BOROUGHS)))
        .withColumns({date: parsed_date(F.col(date)),
                      "work_location_borough": rules.official_borough(borough)})
        .withColumn(date, plausible_date(F.col(date)))
    )


def plausible(df: DataFrame) -> DataFrame:
    """No negative pay (null is not negative), no negative or missing hours."""
    negative = reduce(Column.__or__, [true(F.col(c) < 0) for c in PAY_COLUMNS])
    return df.where(~negative & (F.col("regular_hours") >= 0) & (F.col("ot_hours") >= 0))


def standardised(df: DataFrame) -> DataFrame:
    """Tenure on 30 June of the fiscal year, standard agency, title category, standard title."""
    tenure = tenure_at_june_30(F.col("fiscal_year"), F.col("agency_start_date"))
    return rules.with_standard_names(df.withColumn("employee_agency_tenure", tenure))


def annual(df: DataFrame) -> DataFrame:
    return df.where(F.col("pay_basis") == "per Annum")


def analysis_years(df: DataFrame) -> DataFrame:
    return df.where(F.col("fiscal_year").between(FIRST_YEAR, LAST_YEAR))


def _screened(raw: DataFrame) -> DataFrame:
    return plausible(located(raw)).drop("mid_init")


def standard_payroll(raw: DataFrame) -> DataFrame:
    """Clean records of every pay basis and year."""
    return standardised(_screened(raw.distinct()))


def clean_payroll(raw: DataFrame) -> DataFrame:
    """Clean records of annual staff, 2015 to 2024."""
    return analysis_years(annual(standard_payroll(raw)))


def with_total_compensation(df: DataFrame) -> DataFrame:
    parts = [F.coalesce(F.col(c), F.lit(0.0)) for c in PAY_COLUMNS[1:]]
    return df.withColumn("total_compensation", reduce(Column.__add__, parts))


def _meaningful(df: DataFrame) -> DataFrame:
    hours, comp = F.col("regular_hours"), F.col("total_compensation")
    tracked = true(hours > 0)
    enough = (tracked & (hours >= 1000) & (comp >= 20_000)) | (~tracked & (comp >= 30_000))
    return (
        with_total_compensation(df).where((comp > 0) & enough)
        .withColumn("hours_tracked", tracked)
        .withColumn("employment_type", bucket(hours, EMPLOYMENT_HOURS, include_lowest=True))
    )


def meaningful_employment(clean: DataFrame) -> DataFrame:
    """Clean records with meaningful hours or pay."""
    return _meaningful(clean.drop("pay_basis", STATUS).distinct())


def analysis_population(raw: DataFrame) -> DataFrame:
    """meaningful_employment(clean_payroll(raw)) with one shuffle instead of two.

    Steps between the two distincts work row by row, so the first changes nothing, and
    derived columns are added after the shuffle.
    """
    rows = analysis_years(annual(_screened(raw))).drop("pay_basis", STATUS)
    return _meaningful(standardised(rows.distinct()))


def employment_files(population: DataFrame) -> dict[str, DataFrame]:
    """The three published tables: staff with tracked hours, salaried staff, all."""
    return {
        "hourly": population.where("hours_tracked"),
        "salaried": population.where("not hours_tracked"),
        "combined": population,
    }
