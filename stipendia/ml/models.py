"""The five regression models, their training, evaluation and persistence."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipendia import session
from stipendia.ml import penalty, trees
from stipendia.ml.cells import TARGET, cells, metrics, prepared
from stipendia.ml.preprocess import FEATURES, feature_names, fit_preprocessor
from stipendia.operators.ranks import join_on
from stipendia.plans.features import model_columns
from stipendia.plans.scoring import score_with_errors
from stipendia.sources.payroll import load_optional

# Default penalties and model settings.
DEFAULT_ALPHA = {"linear": 0.0, "ridge": 1.0, "lasso": 0.001, "elasticnet": 0.001}
FOREST = {"numTrees": 100, "maxDepth": 10, "seed": 42}
MIN_SPLIT_ROWS = 50
BOOSTING = {"maxIter": 100, "stepSize": 0.3, "maxDepth": 6, "l2": 1.0, "minInfoGain": 0.0, "columnRate": 1.0,
            "subsamplingRate": 1.0, "seed": 42}


def forest_growth() -> trees.Growth:
    return trees.Growth(FOREST["maxDepth"], least_split=MIN_SPLIT_ROWS, seed=FOREST["seed"])


def boosting(fold: int | None = None, **parameters) -> trees.Model:
    """A boosted model to be grown, with the default settings for those not given."""
    chosen = {**BOOSTING, **parameters}
    growth = trees.Growth(chosen["maxDepth"], l2=chosen["l2"], least_gain=chosen["minInfoGain"],
                          columns=chosen["columnRate"], records=chosen["subsamplingRate"], seed=chosen["seed"])
    return trees.Model(growth, chosen["maxIter"], chosen["stepSize"], fold)


@dataclass
class Setup:
    """Fitted preprocessing and the transformed training cells."""

    categorical: list[str]
    numeric: list[str]
    preprocessor: PipelineModel
    training: DataFrame

    @cached_property
    def products(self) -> penalty.Products:
        """Sums of products of the training cells; all linear models start from them."""
        return penalty.products(self.training)

    @cached_property
    def binned(self) -> trees.Binned:
        """The training cells with binned inputs; trees start from them."""
        return trees.binned(self.training)

    def cells(self, df: DataFrame, *keep: str) -> DataFrame:
        return self.preprocessor.transform(cells(df, self.categorical, self.numeric, *keep))

    def pipeline(self, model) -> PipelineModel:
        return PipelineModel(stages=[*self.preprocessor.stages, model])

    def predictions(self, found: dict[str, object], df: DataFrame) -> DataFrame:
        """What each model says for each distinct input of a table, a column a model, written."""
        inputs = [*self.categorical, *self.numeric]
        scored = self.preprocessor.transform(prepared(df, self.categorical, self.numeric).distinct())
        for name, model in found.items():
            scored = model.transform(scored).withColumnRenamed("prediction", f"by_{name}")
        return session.written(scored.select(*inputs, *[f"by_{name}" for name in found]), "predictions")

    def compare(self, found: dict[str, object], test: DataFrame) -> DataFrame:
        """r2, RMSE and MAE over all test records, a row a model; all models in one pass over the records.

        Models see each distinct input once. Predictions are written before records are joined to them, so records
        are shuffled only where the inputs are too many to be broadcast.
        """
        inputs = [*self.categorical, *self.numeric]
        rows = prepared(test, self.categorical, self.numeric, TARGET).where(F.col(TARGET).isNotNull())
        known = join_on(rows, self.predictions(found, test), inputs, "inner")
        scores = [metrics(F.col(TARGET), F.col(f"by_{name}"), F.lit(1.0)).alias(name) for name in found]
        listed = F.array(*[F.struct(F.lit(name).alias("model"), *[
            F.col(name)[c].alias(c) for c in ("rows", "r2", "rmse", "mae")]) for name in found])
        return known.agg(*scores).select(F.inline(listed))

    def evaluate(self, model, test: DataFrame) -> DataFrame:
        """r2, RMSE and MAE over all test records."""
        return self.compare({"one": model}, test).drop("model")


def prepare(train: DataFrame, *keep: str) -> Setup:
    """Cells and preprocessing of the training table."""
    categorical, numeric = model_columns(train)
    data = cells(train, categorical, numeric, *keep)
    fitted = fit_preprocessor(data, categorical, numeric)
    return Setup(categorical, numeric, fitted, fitted.transform(data))


def predict(pipeline: PipelineModel, rows: DataFrame, year: int | None = None) -> DataFrame:
    """Salaries for prepared rows, of one year if wanted, with errors where actuals exist."""
    chosen = rows if year is None else rows.where(F.col("fiscal_year") == year)
    scored = pipeline.transform(chosen).withColumnRenamed("prediction", "predicted_log_salary")
    return score_with_errors(scored)


def train_forest(data: trees.Binned) -> RandomForestRegressionModel:
    found, = trees.forest(data, FOREST["numTrees"], forest_growth())
    return trees.forest_model(data.table.sparkSession, found, data)


def train_boosting(data: trees.Binned, **parameters) -> GBTRegressionModel:
    model, = trees.boost(data, [boosting(**parameters)])
    return trees.boosted_model(data.table.sparkSession, model, data)


def train_linear(setup: Setup, alphas: dict[str, float | None]) -> dict[str, LinearRegressionModel]:
    """Models of the linear family on all training records, with their default penalty for None."""
    grids = {kind: [DEFAULT_ALPHA[kind] if alpha is None else alpha] for kind, alpha in alphas.items()}
    found = penalty.fit(setup.products, grids, [-1])
    return {kind: penalty.model(setup.training.sparkSession, fit.weights[0, 0], fit.intercepts[0, 0])
            for kind, fit in found.items()}


def train_model(kind: str, setup: Setup, alpha: float | None = None):
    if kind in DEFAULT_ALPHA:
        return train_linear(setup, {kind: alpha})[kind]
    return train_forest(setup.binned) if kind == "rf" else train_boosting(setup.binned)


def feature_importance(spark: SparkSession, model, transformed: DataFrame) -> DataFrame:
    """Coefficients with their names and size. One row per vector entry, as in the model."""
    pairs = zip(feature_names(transformed), model.coefficients.toArray().tolist())
    table = spark.createDataFrame(list(pairs), "feature string, coefficient double")
    return table.withColumn("abs_coefficient", F.abs("coefficient"))


def top_features(importance: DataFrame, top: int = 50, sign: int = 0) -> DataFrame:
    """Largest coefficients; with a sign only positive or only negative ones."""
    chosen = importance if not sign else importance.where(F.signum("coefficient") == sign)
    return chosen.orderBy(F.desc("abs_coefficient"), "feature").limit(top)


def above_threshold(importance: DataFrame, threshold: float = 0.05) -> DataFrame:
    return importance.where(F.col("abs_coefficient") > threshold)


# Feature categories by keyword.
CATEGORIES = {
    "Tenure": ["tenure"],
    "Year/Fiscal": ["fiscal_year", "year"],
    "Title": ["title_"],
    "Agency": ["agency_"],
    "Salary Stats": ["median", "avg", "salary"],
    "Pay Basis": ["pay_basis", "hourly"],
    "Location": ["borough"],
    "Employment": ["employment"],
    "OT/Hours": ["ot_", "hours"],
}


def importance_by_category(importance: DataFrame) -> DataFrame:
    """Coefficients summed up per category; a feature counts in every category it names."""
    name = F.lower("feature")
    hits = F.array_compact(F.array(*[
        F.when(name.rlike("|".join(words)), F.lit(category))
        for category, words in CATEGORIES.items()
    ]))
    size = F.col("abs_coefficient")
    return importance.withColumn("category", F.explode(hits)).groupBy("category").agg(
        F.count("*").alias("features"), F.avg(size).alias("mean_abs_coefficient"),
        F.sum("coefficient").alias("total_coefficient"),
        F.max_by("feature", F.struct(size, F.col("feature"))).alias("top_feature"),
    )


def save_model(spark: SparkSession, model: PipelineModel, folder: str, name: str, **scores: float):
    """Save a pipeline and add its scores to the registry table beside it."""
    path = f"{folder}/salary_model_{name}"
    model.write().overwrite().save(path)
    row = {"name": name, "path": path, "test_r2": None, "best_cv_r2": None, "r2": None, **scores}
    schema = "name string, path string, test_r2 double, best_cv_r2 double, r2 double"
    spark.createDataFrame([row], schema).write.mode("append").json(f"{folder}/registry")


def load_registry(spark: SparkSession, folder: str) -> DataFrame | None:
    return load_optional(spark, f"{folder}/registry", "json")
