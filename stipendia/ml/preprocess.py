"""Model inputs to one feature vector: one-hot categories and standardised numbers."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipendia.ml.cells import COUNT
from stipendia.operators.ranks import quantiles_of_counts, value_counts
from stipendia.operators.tall import tall

FEATURES = "features"


def _medians(data: DataFrame, numeric: list[str]) -> dict[str, float]:
    values = tall(data, numeric, "double", keep=[COUNT])
    counts = value_counts(values, ["column_name"], F.col("value"), F.col(COUNT))
    rows = quantiles_of_counts(counts, ["column_name"], {"median": 0.5}, None).collect()
    return {r.column_name: r.median for r in rows}


def _moments(data: DataFrame, medians: dict[str, float]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, over records, with gaps filled."""
    n, aggregates = F.col(COUNT), []
    for c, median in medians.items():
        # Distances from the median keep the squares small.
        away = F.coalesce(F.col(c), F.lit(median)) - median
        aggregates += [(F.sum(n * away) / F.sum(n)).alias(f"{c}__m"),
                       (F.sum(n * away * away) / F.sum(n)).alias(f"{c}__s")]
    row = data.agg(*aggregates).first()
    out = {}
    for c, median in medians.items():
        shift = row[f"{c}__m"]
        variance = max(row[f"{c}__s"] - shift * shift, 0.0)
        out[c] = (median + shift, variance**0.5 if variance > 1e-12 else 1.0)
    return out


def fit_preprocessor(data: DataFrame, categorical: list[str], numeric: list[str]) -> PipelineModel:
    """Fit on cells. Unknown categories become all zeros; gaps get the median of the records."""
    medians = _medians(data, numeric) if numeric else {}
    known = [c for c in numeric if c in medians]
    scales = _moments(data, medians) if known else {}
    shaped = [f"coalesce(cast({c} as string), 'nan') as {c}__text" for c in categorical] + [
        f"(coalesce(cast({c} as double), {medians[c]!r}D) - {scales[c][0]!r}D) / "
        f"{scales[c][1]!r}D as {c}__z" for c in known
    ]
    stages = [SQLTransformer(statement=f"select *, {', '.join(shaped)} from __THIS__")]
    if categorical:
        stages += [
            StringIndexer(inputCols=[f"{c}__text" for c in categorical],
                          outputCols=[f"{c}__index" for c in categorical],
                          handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=[f"{c}__index" for c in categorical],
                          outputCols=[f"{c}__hot" for c in categorical], dropLast=True),
        ]
    inputs = [f"{c}__hot" for c in categorical] + [f"{c}__z" for c in known]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES))
    return Pipeline(stages=stages).fit(data)


def feature_names(transformed: DataFrame) -> list[str]:
    """Names of the vector's entries, in the order of the vector."""
    groups = transformed.schema[FEATURES].metadata["ml_attr"]["attrs"]
    entries = sorted((a["idx"], a["name"]) for part in groups.values() for a in part)
    return [name.replace("__hot", "").replace("__z", "") for _, name in entries]
