"""Wide to long, so that per-column statistics are one grouped aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tall(df: DataFrame, columns: list[str], cast: str, keep: list[str] = ()) -> DataFrame:
    """One row per (row, column): `column_name` and `value`."""
    pairs = F.explode(
        F.array(
            *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast(cast).alias("value"))
              for c in columns]
        )
    ).alias("_pair")
    return df.select(*keep, pairs).select(*keep, "_pair.column_name", "_pair.value")


def tall_row(row: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """One wide row of aggregates `<column>__<suffix>` to one row per column."""
    pairs = F.explode(
        F.array(
            *[F.struct(F.lit(c).alias("column_name"),
                       *[F.col(f"{c}__{s}").alias(s) for s in names]) for c in columns]
        )
    ).alias("_pair")
    return row.select(pairs).select("_pair.*")
