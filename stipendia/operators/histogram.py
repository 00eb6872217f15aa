"""Equal-width histograms over value counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipendia.operators.ranks import fold, join_on, quantiles_of_counts


def auto_bins() -> Column:
    """Number of bins by the wider count of two rules: quartile distance and sample size."""
    span = F.col("_high") - F.col("_low")
    n = F.col("_rows").cast("double")
    by_size = span / (F.log2(n) + 1)
    by_quartiles = 2 * (F.col("_q3") - F.col("_q1")) / F.pow(n, F.lit(1 / 3))
    width = F.when(by_quartiles > 0, F.least(by_quartiles, by_size)).otherwise(by_size)
    return F.greatest(F.ceil(F.try_divide(span, width)), F.lit(1))


def histogram(counts: DataFrame, keys: list[str], bins: int | None, step: float | None) -> DataFrame:
    """Rows per non-empty bin for each group of (value `_v`, count `_n`) rows.

    `bins` equal bins from minimum to maximum; None chooses the number per group. The
    maximum belongs to the last bin.
    """
    stats = counts.groupBy(*keys).agg(
        F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.sum("_n").alias("_rows")
    )
    if bins is None:
        quartiles = quantiles_of_counts(counts, keys, {"_q1": 0.25, "_q3": 0.75}, step)
        stats = fold([stats, quartiles], keys).withColumn("_bins", auto_bins())
    else:
        stats = stats.withColumn("_bins", F.lit(bins).cast("long"))
    placed = join_on(counts, stats, keys, "inner")
    span = F.col("_high") - F.col("_low")
    place = F.floor(F.try_divide((F.col("_v") - F.col("_low")) * F.col("_bins"), span))
    last = F.col("_bins") - 1
    width = F.col("_span") / F.col("_bins")
    return (
        placed.withColumn("bin", F.least(F.coalesce(place, F.lit(0)), last))
        .withColumn("_span", span)
        .groupBy(*keys, "bin", "_low", "_span", "_bins", "_rows").agg(F.sum("_n").alias("n"))
        .select(
            *keys, "bin", "n",
            (F.col("_low") + F.col("bin") * width).alias("bin_low"),
            (F.col("_low") + (F.col("bin") + 1) * width).alias("bin_high"),
            F.try_divide(F.col("n").cast("double"), F.col("_rows") * width).alias("density"),
        )
    )


def nice_width(span: Column, most: int) -> Column:
    """The smallest of 1, 2, 5 times a power of ten that needs at most `most` bins."""
    exact = span / most
    power = F.pow(F.lit(10.0), F.floor(F.log10(exact)))
    lead = exact / power
    factor = F.when(lead <= 1, 1).when(lead <= 2, 2).when(lead <= 5, 5).otherwise(10)
    return power * factor
