"""Stored tables that grow or change by one delivery, without reading what did not change.

`add_records` removes repeated rows over all deliveries: a delivery is compared with digests of the rows
that are stored, never with the rows. `refresh_panel` keeps the yearly panel: a corrected year rewrites its own
partition and that of the year after it, whose growth refers to it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipendia import session
from stipendia.functions.scalars import percent
from stipendia.operators.ranks import join_on
from stipendia.plans.features import yoy_summary

DIGEST = "_digest"
PANEL_KEY = ["title_std", "agency_std"]


def row_digest(columns: list[str]):
    """128 bits of a row. Nulls differ from every text, and lengths keep neighbouring cells apart."""
    def shown(name: str):
        text = F.col(name).cast("string")
        return F.coalesce(F.concat_ws(":", F.length(text), text), F.lit("~"))

    return F.unhex(F.md5(F.concat_ws("|", *map(shown, sorted(columns)))))


def _records(spark: SparkSession, store: str) -> DataFrame | None:
    """The records of all deliveries with their digests; None before the first one."""
    path = f"{store}/records"
    return spark.read.parquet(path) if session.exists(spark, path) else None


def add_records(store: str, delivery: DataFrame, batch: int) -> None:
    """Store the rows of a delivery that no other delivery has, once each.

    Of the stored rows only 16 bytes each are read and shuffled. Digests of the delivery are compared first, so rows
    are shuffled for what is new: a delivery without news moves digests only. Records keep their digests, each
    delivery in its own partition, and a delivery isn't compared with itself: one that was cut off, or that is
    delivered twice under its number, is simply added again. Two deliveries must not be added at the same time.
    """
    spark = delivery.sparkSession
    rows = delivery.withColumn(DIGEST, row_digest(delivery.columns))
    known = _records(spark, store)
    if known is not None:
        others = known.where(F.col("batch") != batch).select(DIGEST)
        fresh = session.written(rows.select(DIGEST).distinct().join(others, DIGEST, "left_anti"), "fresh")
        rows = rows.limit(0) if fresh.isEmpty() else rows.join(fresh, DIGEST, "left_semi")
    rows.distinct().write.mode("overwrite").option("compression", "zstd").parquet(f"{store}/records/batch={batch}")


def stored_records(spark: SparkSession, store: str) -> DataFrame:
    """All stored rows with the number of the delivery they came with."""
    return _records(spark, store).drop(DIGEST)


def _with_growth(panel: DataFrame, prior: DataFrame) -> DataFrame:
    """Median salary of the year before and the change in percent; null without such a year."""
    before = prior.select((F.col("fiscal_year") + 1).alias("fiscal_year"), *PANEL_KEY,
                          F.col("base_salary").alias("prior_salary"))
    change = F.col("base_salary") - F.col("prior_salary")
    return join_on(panel, before, ["fiscal_year", *PANEL_KEY], filled="fiscal_year").withColumn(
        "growth_pct", percent(change, F.col("prior_salary")))


def growing_panel(features: DataFrame) -> DataFrame:
    """Yearly panel with the change against the year before, from all records."""
    panel = yoy_summary(features)
    return _with_growth(panel, panel)


def write_panel(store: str, features: DataFrame) -> None:
    """The panel of all years, one partition a year."""
    panel = session.written(yoy_summary(features), "panel-years")
    _with_growth(panel, panel).hint("rebalance", "fiscal_year").write.mode("overwrite").partitionBy(
        "fiscal_year").parquet(store)


def refresh_panel(store: str, features: DataFrame, years: Iterable[int]) -> None:
    """Bring the given years up to date after their records have changed.

    Records of these years are read, and of the stored panel the years before and after them. The years themselves and
    the stored ones right after them are replaced; files of all other years stay as they are. A year
    without records any more loses its partition.
    """
    spark, touched = features.sparkSession, sorted(set(years))
    year = F.col("fiscal_year")
    near = {y + d for y in touched for d in (-1, 1)} - set(touched)
    fresh = yoy_summary(features.where(year.isin(touched)))
    stored = spark.read.parquet(store)
    around = stored.where(year.isin(sorted(near))).select(fresh.columns)
    panel = session.written(fresh.unionByName(around), "panel-years")
    successors = {y + 1 for y in touched}
    changed = session.written(
        _with_growth(panel.where(year.isin(sorted({*touched, *successors}))), panel), "panel-changed")
    left = {r.fiscal_year for r in changed.select("fiscal_year").distinct().collect()}
    changed.select(stored.columns).hint("rebalance", "fiscal_year").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("fiscal_year").parquet(store)
    for gone in set(touched) - left:
        session.remove(spark, f"{store}/fiscal_year={gone}")
