"""Joins of records to lookup tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stipendia.operators.ranks import join_on


def attach(df: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join records to an aggregate of them; building the plan starts no job.

    Adaptive execution knows the aggregate's size when it is made: a small one is broadcast; for a
    large one it splits hot keys.
    """
    return join_on(df, lookup, keys, how)
