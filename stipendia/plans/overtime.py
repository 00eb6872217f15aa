"""Segments, overtime marts and top earners. Input: the analysis population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipendia.functions.buckets import OT_DOLLARS, bucket, position
from stipendia.functions.scalars import count_where, percent
from stipendia.operators.ranks import MONEY_STEP, summarize
from stipendia.schema import EMPLOYEE_ORDER, FIRST_YEAR, LAST_YEAR

# The agencies of the first two segments.
EDUCATION = "Department of Education"
UNIFORMED = [
    "Police Department", "Fire Department", "Department of Correction", "Department of Sanitation",
]

EXTREME_OT = 100_000


def ot() -> Column:
    return F.col("total_ot_paid")


def comp() -> Column:
    return F.col("total_compensation")


def paid_ot() -> Column:
    return F.when(ot() > 0, ot())


def hourly(population: DataFrame) -> DataFrame:
    return population.where("hours_tracked")


def with_segment(population: DataFrame) -> DataFrame:
    agency = F.col("agency_std")
    return population.withColumn(
        "segment",
        F.when(agency == EDUCATION, "DOE").when(agency.isin(UNIFORMED), "Uniformed")
        .otherwise("Civilian"),
    )


def _of_total(count: str) -> Column:
    return percent(F.col(count), F.sum(count).over(Window.partitionBy(F.lit(0))))


def segment_counts(population: DataFrame) -> DataFrame:
    """Records per segment and their share; the segments are disjoint and complete."""
    return (
        with_segment(population).groupBy("segment").agg(F.count("*").alias("records"))
        .withColumn("pct", _of_total("records"))
    )


def segment_profile(population: DataFrame) -> DataFrame:
    return summarize(
        with_segment(population), ["segment"],
        [
            F.count("*").alias("records"), F.avg(comp()).alias("avg_comp"),
            F.max(comp()).alias("max_comp"), F.avg("base_salary").alias("avg_base"),
            F.avg(ot()).alias("avg_ot"), percent(F.sum(ot()), F.sum(comp())).alias("ot_pct_comp"),
            F.count_distinct("agency_std").alias("agencies"),
            F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"),
        ],
        (comp(), {"median_comp": 0.5}, MONEY_STEP),
    )


def ot_overview(population: DataFrame) -> DataFrame:
    rows = F.count("*")
    return summarize(
        hourly(population), [],
        [
            F.sum(comp()).alias("total_payroll"), F.sum(ot()).alias("total_ot"),
            percent(F.sum(ot()), F.sum(comp())).alias("ot_pct_payroll"),
            count_where(ot() > 0).alias("workers_with_ot"),
            count_where(ot() == 0).alias("workers_no_ot"),
            percent(count_where(ot() > 0), rows).alias("pct_with_ot"),
            percent(count_where(ot() == 0), rows).alias("pct_no_ot"),
            F.avg(ot()).alias("avg_ot_all"), F.avg(paid_ot()).alias("avg_ot_workers"),
            F.max(ot()).alias("max_ot"),
        ],
        (paid_ot(), {"median_ot_workers": 0.5}, MONEY_STEP),
    )


def ot_by_segment(population: DataFrame) -> DataFrame:
    return summarize(
        with_segment(population).where(F.col("segment") != "DOE"), ["segment"],
        [
            count_where(ot() > 0).alias("workers_with_ot"),
            percent(count_where(ot() > 0), F.count("*")).alias("pct_with_ot"),
            F.avg(paid_ot()).alias("avg_ot_workers"),
            percent(F.sum(ot()), F.sum(comp())).alias("ot_pct_comp"), F.max(ot()).alias("max_ot"),
        ],
        (paid_ot(), {"median_ot_workers": 0.5}, MONEY_STEP),
    )


def ot_by_agency(population: DataFrame, top: int = 15) -> DataFrame:
    return (
        hourly(population).groupBy("agency_std")
        .agg(
            F.sum(ot()).alias("total_ot"), F.avg(ot()).alias("avg_ot"), F.count(ot()).alias("workers"),
            count_where(ot() > 0).alias("ot_workers"), F.sum(comp()).alias("total_comp"),
        )
        .withColumn("ot_pct_payroll", percent(F.col("total_ot"), F.col("total_comp")))
        .withColumn("ot_worker_pct", percent(F.col("ot_workers"), F.col("workers")))
        .orderBy(F.desc("total_ot"), "agency_std").limit(top)
    )


def ot_trend(population: DataFrame) -> DataFrame:
    return (
        hourly(population).groupBy("fiscal_year")
        .agg(F.sum(ot()).alias("total_ot"), F.avg(ot()).alias("avg_ot"),
             F.sum(comp()).alias("total_comp"), F.count(ot()).alias("headcount"))
        .withColumn("ot_pct", percent(F.col("total_ot"), F.col("total_comp")))
    )


def ot_brackets(population: DataFrame) -> DataFrame:
    """Workers per bracket; zero overtime is in no bracket but counts in the share's total."""
    bracket = F.col("ot_bracket")
    return (
        hourly(population).withColumn("ot_bracket", bucket(ot(), OT_DOLLARS)).groupBy("ot_bracket")
        .agg(F.count(ot()).alias("workers"), F.avg(ot()).alias("avg_ot"), F.sum(ot()).alias("total_ot"),
             F.count("*").alias("_rows"))
        .withColumn("worker_pct", percent(
            F.col("workers"), F.sum("_rows").over(Window.partitionBy(F.lit(0)))))
        .where(bracket.isNotNull())
        .withColumn("bracket_order", position(bracket, OT_DOLLARS)).drop("_rows")
    )


# The four reviewed groups.
REVIEWED = {
    "Board Of Election": "agency_std = 'Board Of Election' and hours_tracked",
    "Chief Marine Engineer": "title_std = 'Chief Marine Engineer' and segment = 'Civilian'",
    "Department of Correction": "agency_std = 'Department of Correction'",
    "Fire Department": "agency_std = 'Fire Department'",
}


def ot_deep_dive(population: DataFrame, groups: dict[str, str] = REVIEWED) -> DataFrame:
    """Yearly overtime of named groups in one pass: a record is tagged with its groups."""
    tags = F.array_compact(F.array(*[F.when(F.expr(t), F.lit(name)) for name, t in groups.items()]))
    return (
        with_segment(population).withColumn("subject", F.explode(tags))
        .groupBy("subject", "fiscal_year")
        .agg(
            F.count(ot()).alias("headcount"), F.sum(ot()).alias("total_ot"), F.avg(ot()).alias("avg_ot"),
            F.avg(comp()).alias("avg_comp"), count_where(ot() > EXTREME_OT).alias("extreme_ot"),
            percent(F.sum(ot()), F.sum(comp())).alias("ot_pct_comp"),
        )
    )


def top_ot_agency_per_year(population: DataFrame) -> DataFrame:
    """The agency with most extreme overtime in each year."""
    per_agency = (
        hourly(population)
        .where((ot() > EXTREME_OT) & F.col("fiscal_year").between(FIRST_YEAR, LAST_YEAR))
        .groupBy("fiscal_year", "agency_std")
        .agg(F.count(ot()).alias("workers"), F.avg(ot()).alias("avg_ot"), F.sum(ot()).alias("total_ot"))
    )
    order = Window.partitionBy("fiscal_year").orderBy(F.desc("total_ot"), "agency_std")
    return (
        per_agency.withColumn("_place", F.row_number().over(order)).where("_place = 1")
        .drop("_place")
    )


def _two_years(population: DataFrame, before: int, after: int) -> DataFrame:
    """Overtime and headcount of both years per agency; a missing year counts as 0."""
    def in_year(year: int) -> Column:
        return F.col("fiscal_year") == year

    def spent(year: int) -> Column:
        return F.sum(F.when(in_year(year), ot()).otherwise(0.0))

    return (
        hourly(population).where(F.col("fiscal_year").isin(before, after)).groupBy("agency_std")
        .agg(
            spent(before).alias("ot_before"), spent(after).alias("ot_after"),
            count_where(in_year(before)).alias("headcount_before"),
            count_where(in_year(after)).alias("headcount_after"),
        )
        .withColumn("ot_change", F.col("ot_after") - F.col("ot_before"))
        .withColumn("ot_change_pct", percent(F.col("ot_change"), F.col("ot_before")))
        .withColumn("headcount_change", F.col("headcount_after") - F.col("headcount_before"))
    )


def ot_change(population: DataFrame, before: int = 2021, after: int = 2022, top: int = 12):
    """Agencies whose overtime rose most."""
    both = _two_years(population, before, after)
    return both.orderBy(F.desc("ot_change"), "agency_std").limit(top)


def headcount_change(population: DataFrame, before: int = 2021, after: int = 2022, top: int = 10):
    """Agencies that lost most staff."""
    both = _two_years(population, before, after).drop("ot_before", "ot_after", "ot_change",
                                                      "ot_change_pct")
    return both.orderBy("headcount_change", "agency_std").limit(top)


def ot_hours_break(population: DataFrame, year: int = 2023) -> DataFrame:
    """Mean overtime hours on both sides of the change of method; only `after` is reliable."""
    flagged = population.withColumn("ot_hours_reliable", F.col("fiscal_year") >= year)
    reliable = F.col("ot_hours_reliable")
    return flagged.agg(
        F.avg(F.when(~reliable, F.col("ot_hours"))).alias("avg_ot_hours_before"),
        F.avg(F.when(reliable, F.col("ot_hours"))).alias("avg_ot_hours_after"),
        count_where(reliable).alias("reliable_rows"),
    )


def high_earner_counts(population: DataFrame) -> DataFrame:
    return population.agg(
        *[count_where(comp() > k * 1000).alias(f"above_{k}k") for k in (200, 300, 500)]
    )


_EARNER = [
    "agency_std", "title_std", "title_category", "base_salary", "total_ot_paid",
    "total_compensation", "fiscal_year", "first_name", "last_name",
]


def top_earners(population: DataFrame, top: int = 20) -> DataFrame:
    order = [F.desc("total_compensation"), *EMPLOYEE_ORDER]
    return population.orderBy(*order).limit(top).select(*_EARNER)


def top_ot_civilian(population: DataFrame, top: int = 5) -> DataFrame:
    civilian = with_segment(population).where("segment = 'Civilian'")
    return civilian.orderBy(F.desc("total_ot_paid"), *EMPLOYEE_ORDER).limit(top).select(*_EARNER)
