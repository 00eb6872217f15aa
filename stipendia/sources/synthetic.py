"""Generated payroll records for demos, and the data dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stipendia.functions.scalars import clip

# Salary mean and deviation by title.
TITLES = {
    "POLICE OFFICER": (75_000, 12_000),
    "TEACHER": (72_000, 10_000),
    "FIREFIGHTER": (80_000, 11_000),
    "CIVIL ENGINEER": (90_000, 15_000),
    "SOCIAL WORKER": (60_000, 8_000),
    "STAFF ANALYST": (68_000, 10_000),
    "ADMINISTRATIVE ASSISTANT": (52_000, 7_000),
    "SANITATION WORKER": (65_000, 9_000),
    "NURSE": (88_000, 13_000),
    "ACCOUNTANT": (75_000, 11_000),
    "COMPUTER SYSTEMS MANAGER": (105_000, 18_000),
    "CORRECTION OFFICER": (70_000, 10_000),
    "PARKS WORKER": (48_000, 6_000),
    "ATTORNEY": (98_000, 20_000),
    "BUILDING INSPECTOR": (72_000, 10_000),
}

# Agencies, and the salary factor by borough.
AGENCIES = [
    "POLICE DEPARTMENT", "DEPT OF EDUCATION", "FIRE DEPARTMENT", "DEPT OF TRANSPORTATION",
    "DEPT OF SOCIAL SERVICES", "OFFICE OF MANAGEMENT & BUDGET", "DEPT OF SANITATION",
    "HEALTH AND HOSPITALS CORP", "DEPT OF FINANCE", "DEPT OF PARKS & RECREATION",
]
BOROUGHS = {
    "MANHATTAN": 1.08, "BROOKLYN": 1.00, "QUEENS": 0.98, "BRONX": 0.95, "STATEN ISLAND": 0.97,
}
LOWEST, HIGHEST = 30_000.0, 250_000.0

# The data dictionary.
DICTIONARY = [
    ("title_description", "string", "Standardized job title for the employee.", "POLICE OFFICER"),
    ("agency_name", "string", "NYC agency that employs the worker.", "POLICE DEPARTMENT"),
    ("work_location_borough", "string", "NYC borough where the employee is based.", "MANHATTAN"),
    ("base_salary", "float", "Annual base salary in USD before overtime or other pay.",
     "75000.00"),
    ("fiscal_year", "integer", "NYC fiscal year the record corresponds to (2015–2024).", "2022"),
    ("years_of_service", "integer",
     "Number of full years the employee has been with the city.", "7"),
    ("pay_basis", "string",
     "How the employee is compensated (per Annum, per Hour, per Day).", "per Annum"),
]


def synthetic_payroll(spark: SparkSession, rows: int = 5_000, seed: int = 42) -> DataFrame:
    """Records drawn per partition, so that any number of them can be made."""
    def draw(stream: int, count: int) -> Column:
        return F.floor(F.rand(seed + stream) * count).cast("int")

    def pick(values, place: str) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col(place) + 1)

    drawn = spark.range(rows).select(
        draw(1, len(TITLES)).alias("t"), draw(2, len(AGENCIES)).alias("a"),
        draw(3, len(BOROUGHS)).alias("b"), (draw(4, 10) + 2015).alias("fiscal_year"),
        draw(5, 35).alias("years_of_service"), F.rand(seed + 6).alias("p"),
        F.randn(seed + 7).alias("z"), (F.rand(seed + 8) * 1000 + 500).alias("premium"),
    )
    means, deviations = zip(*[map(float, v) for v in TITLES.values()])
    salary = pick(means, "t") + pick(deviations, "t") * F.col("z")
    salary = (salary + F.col("years_of_service") * F.col("premium")) * pick(BOROUGHS.values(), "b")
    return drawn.select(
        pick(TITLES, "t").alias("title_description"), pick(AGENCIES, "a").alias("agency_name"),
        pick(BOROUGHS, "b").alias("work_location_borough"),
        F.round(clip(salary, LOWEST, HIGHEST), 2).alias("base_salary"), "fiscal_year",
        "years_of_service",
        F.when(F.col("p") < 0.9, "per Annum").when(F.col("p") < 0.95, "per Hour")
        .otherwise("per Day").alias("pay_basis"),
    )


def data_dictionary(spark: SparkSession) -> DataFrame:
    names = ["column_name", "data_type", "description", "example"]
    return spark.createDataFrame(DICTIONARY, names)
