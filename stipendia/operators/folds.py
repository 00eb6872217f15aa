"""Fold numbers for cross-validation, assigned without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipendia import session
from stipendia.operators.ranks import labelled, row_mark


def contiguous_folds(df: DataFrame, k: int, name: str = "fold", keep: list[str] | None = None) -> DataFrame:
    """k contiguous folds whose sizes differ by at most one, larger folds first.

    The fixed order is a digest of the whole row, ties broken by the row itself, so the
    folds depend on the data only, never on partitions. `keep` names the columns that are
    wanted, all by default; the digest is of all columns in any case. Digests are made once and
    written beside the wanted columns, as the passes that place rows would each make them again.
    """
    def fold(row: Column, total: Column) -> Column:
        small, larger = F.floor(total / k), total % k
        in_larger = larger * (small + 1)
        return F.when(row < in_larger, F.floor(F.try_divide(row, small + 1))).otherwise(
            larger + F.floor(F.try_divide(row - in_larger, small))).cast("int")

    wanted = df.columns if keep is None else [c for c in df.columns if c in keep]
    marked = session.written(df.select(*wanted, row_mark(df.columns).alias("_digest")), "marked")
    return labelled(marked, [], F.col("_digest"), fold, name).drop("_digest")


def group_folds(df: DataFrame, k: int, group: list[Column], name: str = "fold") -> DataFrame:
    """Every row of a group lands in the same fold."""
    return df.withColumn(name, F.pmod(F.xxhash64(*group), F.lit(k)).cast("int"))
