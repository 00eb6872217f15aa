"""A payroll table derived from order lines, so that its size follows the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stipendia.schema import RAW_TYPES

# Agency by customer key modulo 16, title by part key modulo 24.
AGENCIES = [
    "DEPT OF ED PEDAGOGICAL", "DEPT OF ED PEDAGOGICAL", "DEPT OF ED PARA PROFESSIONALS",
    "POLICE DEPARTMENT", "POLICE DEPARTMENT", "FIRE DEPARTMENT", "DEPARTMENT OF CORRECTION",
    "DEPARTMENT OF SANITATION", "HRA/DEPT OF SOCIAL SERVICES", "ADMIN FOR CHILDREN SVCS",
    "DEPT OF PARKS & RECREATION", "BOARD OF ELECTION", "DEPT OF HEALTH/MENTAL HYGIENE",
    "NYC HOUSING AUTHORITY", " department of  finance ", None,
]
TITLES = [
    "TEACHER", "TEACHER", "TEACHER SPECIAL EDUCATION", "ANNUAL ED PARA", "POLICE OFFICER",
    "P.O. DA DET GR3", "SERGEANT-", "LIEUTENANT D/A SPECIAL ASSIGNMENT",
    "SENIOR POLICE ADMINISTRATIVE AIDE", "FIREFIGHTER", "EMERGENCY MEDICAL SPECIALIST-PARAMEDIC",
    "EMERGENCY MEDICAL SPECIALIST-EMT", "CORRECTION OFFICER", "SANITATION WORKER", "CARETAKER",
    "COMMUNITY ASSOCIATE", "COMPUTER SYSTEMS MANAGER", "CHIEF MARINE  ENGINEER", "STAFF NURSE",
    "CLERICAL ASSOCIATE", "CIVIL ENGINEER", "ASSISTANT PRINCIPAL", "GARDENER", "PRESIDENT",
]
BOROUGHS = [
    "MANHATTAN", "BROOKLYN", "QUEENS", "BRONX", "RICHMOND", "Bronx", "Manhattan", "Brooklyn",
    "WESTCHESTER", "MANHATTAN", None,
]


def _pick(values: list, key: Column) -> Column:
    pool = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(pool, (key % len(values) + 1).cast("int"))


def _two_digits(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _whole(c: Column) -> Column:
    return F.floor(c).cast("double")


def payroll_from(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """One payroll record per order line; lines of every 50th order occur twice."""
    lines = lineitem.join(
        orders.select("o_orderkey", "o_custkey", "o_orderdate"),
        lineitem.l_orderkey == orders.o_orderkey,
    )
    c = F.col
    part, supp, order = c("l_partkey"), c("l_suppkey"), c("l_orderkey")
    price, when = c("l_extendedprice"), c("o_orderdate")
    year = F.when(part % 97 == 5, 1955).otherwise(F.year(when) + supp % 25)
    agency = _pick(AGENCIES, c("o_custkey"))
    record = lines.select(
        (order % 12 + 2014).cast("int").alias("fiscal_year"),
        F.when(supp % 3 != 0, supp.cast("int")).alias("payroll_number"),
        agency.alias("agency_name"),
        F.concat(F.lit("LAST"), supp).alias("last_name"),
        F.concat(F.lit("FIRST"), F.concat_ws("-", order, "l_linenumber", part))
        .alias("first_name"),
        F.when(c("l_linenumber") % 2 != 0, "M").alias("mid_init"),
        F.when(part % 211 == 3, "99/99/9999")
        .when(part % 211 != 4, F.concat_ws(
            "/", _two_digits(F.month(when)), _two_digits(F.least(F.day(when), F.lit(28))), year))
        .alias("agency_start_date"),
        _pick(BOROUGHS, supp).alias("work_location_borough"),
        F.when(part % 96 != 23, _pick(TITLES, part)).alias("title_description"),
        F.when(c("l_linenumber") == 7, "CEASED").when(part % 53 == 0, "ON LEAVE")
        .otherwise("ACTIVE").alias("leave_status_as_of_june_30"),
        F.when(part % 503 == 1, -1.0).when(c("l_quantity") == 1, 5000.0)
        .when(part % 491 == 2, 600000.0).otherwise(_whole(15000 + price * 1.25))
        .alias("base_salary"),
        F.when(c("l_quantity") == 2, "per Hour").when(c("l_quantity") == 3, "per Day")
        .otherwise("per Annum").alias("pay_basis"),
        F.when(agency.like("DEPT OF ED%"), 0.0).when(part % 509 == 6, -8.0)
        .otherwise(c("l_quantity") * 45.0).alias("regular_hours"),
        _whole(14000 + price * 1.2).alias("regular_gross_paid"),
        _whole(c("l_discount") * 4000 + 0.5).alias("ot_hours"),
        _whole(price * c("l_discount") * F.when(part % 40 == 0, 40).otherwise(3))
        .alias("total_ot_paid"),
        _whole(price * c("l_tax") * F.when(part % 37 == 0, 15).otherwise(2))
        .alias("total_other_pay"),
        F.when(order % 50 == 0, 2).otherwise(1).alias("_copies"),
    )
    # One scan and one join: repeats come from an array, not from a second pass.
    return record.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*RAW_TYPES)


def payroll_raw(spark: SparkSession, folder: str) -> DataFrame:
    read = spark.read.parquet
    return payroll_from(read(f"{folder}/lineitem.parquet"), read(f"{folder}/orders.parquet"))
