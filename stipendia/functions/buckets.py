"""Interval labels with a choice of the closed side."""

from __future__ import annotations

from functools import reduce
from math import inf

from pyspark.sql import Column
from pyspark.sql import functions as F

# Edges and labels of every interval family.
MODEL_TENURE = ([-inf, 0, 1, 3, 5, 10, 20, inf], ["0", "1", "2-3", "4-5", "6-10", "11-20", "20+"])
REPORT_TENURE = (
    [-inf, 1, 3, 5, 10, 20, inf],
    ["0-1 years", "2-3 years", "4-5 years", "6-10 years", "11-20 years", "20+ years"],
)
ML_TENURE = ([-inf, 0, 3, 7, 15, inf], ["0", "1-3", "4-7", "8-15", "15+"])
CAREER_TENURE = (
    [0, 5, 10, 20, 35],
    ["Early (0-5)", "Mid (5-10)", "Senior (10-20)", "Veteran (20+)"],
)
LOW_COMP_HOURS = (
    [0, 100, 500, 1000, 2080],
    ["Very Low (<100h)", "Low (100-500h)", "Partial (500-1000h)", "Full Year (1000+h)"],
)
EMPLOYMENT_HOURS = (
    [0, 100, 500, 1000, inf],
    ["Very_Low_Hours", "Part_Year", "Partial_Year", "Full_Year"],
)
OT_DOLLARS = (
    [0, 1, 10_000, 25_000, 50_000, 100_000, inf],
    ["No OT", "Low (<$10k)", "Medium ($10-25k)", "High ($25-50k)", "Very High ($50-100k)",
     "Extreme (>$100k)"],
)


def _inside(c: Column, low: float, high: float, right: bool, lowest: bool) -> Column:
    tests = []
    if low != -inf:
        tests.append(c >= low if (lowest or not right) else c > low)
    if high != inf:
        tests.append(c <= high if right else c < high)
    return reduce(Column.__and__, tests) if tests else c.isNotNull()


def _chain(c: Column, family, values, right: bool, include_lowest: bool) -> Column:
    edges = family[0]
    chain = F
    for i, value in enumerate(values):
        test = _inside(c, edges[i], edges[i + 1], right, include_lowest and i == 0)
        chain = chain.when(test, F.lit(value))
    return chain


def bucket(c: Column, family, right: bool = True, include_lowest: bool = False) -> Column:
    """The label of the interval that holds `c`; null outside all of them.

    `right` closes intervals on the right, (a, b]; otherwise [a, b).
    """
    return F.when(c.isNotNull(), _chain(c, family, family[1], right, include_lowest))


def position(label: Column, family) -> Column:
    """The place of a label in its family, for sorting."""
    chain = F
    for i, name in enumerate(family[1]):
        chain = chain.when(label == name, F.lit(i))
    return chain


def report_tenure(tenure: Column) -> Column:
    return bucket(tenure, REPORT_TENURE, right=False)
