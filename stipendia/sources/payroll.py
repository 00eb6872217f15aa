"""Readers: payroll CSV, split tables and optional reference tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipendia.schema import RAW_TYPES


def snake(name: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"\W+", "_", name.strip().lower())).strip("_")


def standardize_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake(c) for c in df.columns])


def conform(df: DataFrame) -> DataFrame:
    """Cast known payroll columns to their types (bad text is null); others pass unchanged."""
    return df.select(
        *[F.col(c).try_cast(RAW_TYPES[c]).alias(c) if c in RAW_TYPES else F.col(c)
          for c in df.columns]
    )


def load_payroll(spark: SparkSession, path: str) -> DataFrame:
    """Payroll CSV with a header. Columns are read as text, so there is no inference pass."""
    return conform(standardize_column_names(spark.read.csv(path, header=True, escape='"')))


def load_optional(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame | None:
    """A table, or None when there is nothing at the path."""
    try:
        return spark.read.format(format).options(header=True).load(path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def load_splits(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    """Splits of a table partitioned by `split`; only the named partitions are read."""
    table = spark.read.parquet(path)
    return [table.where(F.col("split") == n) for n in names or ("train", "valid", "test")]


def load_columns(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """The named columns of every table that exists, one below the other."""
    found = [t for t in (load_optional(spark, p) for p in paths) if t is not None]
    if not found:
        raise FileNotFoundError(f"none of {paths} exists")
    frames = [t.select(*[c for c in columns if c in t.columns]) for t in found]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
