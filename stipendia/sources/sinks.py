"""Writers. Tables are Parquet, partitioned where readers prune; CSV and JSON on request."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, *partitions: str) -> None:
    """Parquet, one partition folder per value; sizes are evened out, hot values split."""
    if partitions:
        df.hint("rebalance", *partitions).write.mode("overwrite").partitionBy(
            *partitions).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_splits(training: DataFrame, reference: DataFrame, folder: str) -> None:
    """The split tables and their reference table."""
    write_table(training, f"{folder}/splits", "split")
    write_table(reference, f"{folder}/reference")


def write_all(tables: dict[str, DataFrame], folder: str, writer=write_table) -> None:
    for name, df in tables.items():
        writer(df, f"{folder}/{name}")
