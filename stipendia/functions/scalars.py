"""Column expressions shared by all plans; every one stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = "\u0001"


def clip(c: Column, low=None, high=None) -> Column:
    """Bound a value. greatest/least skip nulls, so a null is kept apart."""
    bounded = c
    if low is not None:
        bounded = F.greatest(bounded, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        bounded = F.least(bounded, high if isinstance(high, Column) else F.lit(high))
    return F.when(c.isNotNull(), bounded)


def squeeze(c: Column) -> Column:
    """Every run of whitespace becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    return F.lower(squeeze(F.coalesce(c.cast("string"), F.lit("unknown"))))


def title_case(c: Column) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the others.

    initcap only starts words at blanks, so a marked blank is put before letters that
    follow another non-letter and taken out again.
    """
    marked = F.regexp_replace(F.lower(c), r"(?<=[^\p{L} ])(?=\p{L})", _MARK + " ")
    return F.replace(F.initcap(marked), F.lit(_MARK + " "), F.lit(""))


def to_double(c: Column) -> Column:
    return c.try_cast("double")


def parsed_date(c: Column) -> Column:
    """Month/day/year text, with or without leading zeros; bad text is null."""
    return F.try_to_date(c, "M/d/yyyy")


def plausible_date(c: Column) -> Column:
    return clip(c, F.lit("1970-01-01").cast("date"), F.lit("2025-10-31").cast("date"))


def tenure_at_june_30(year: Column, start: Column) -> Column:
    return clip(F.date_diff(F.make_date(year, F.lit(6), F.lit(30)), start) / F.lit(365.25), 0.0)


def true(c: Column) -> Column:
    """A null condition counts as false."""
    return F.coalesce(c, F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null when b is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(a: Column, b: Column) -> Column:
    return ratio(a.cast("double") * 100, b)


def count_where(condition: Column) -> Column:
    return F.count_if(true(condition))


def log_salary(c: Column) -> Column:
    return F.ln(clip(c, 1.0))


def money(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 0))
