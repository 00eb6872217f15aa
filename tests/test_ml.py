"""Models on cells against closed forms on the single records."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from stipendia import session
from stipendia.ml import models, tuning
from stipendia.plans import registry, scoring


@pytest.fixture(scope="module")
def data(spark):
    """Records that share few inputs, with gaps in a number and in a category."""
    rng = np.random.default_rng(3)
    n = 900
    agency, title = rng.integers(0, 3, n), rng.integers(0, 5, n)
    year = 2015 + rng.integers(0, 4, n)
    median = np.where(agency == 2, np.nan, 50_000.0 + 1_000 * agency)
    y = 11 + 0.1 * agency - 0.2 * title + 0.01 * (year - 2015) + rng.normal(0, 0.1, n)
    pdf = pd.DataFrame({
        "agency_std": [f"a{i}" for i in agency],
        "title_std": [None if i == 4 else f"t{i}" for i in title], "fiscal_year": year,
        "median_salary_by_agency": median, "log_base_salary": y, "base_salary": np.exp(y),
    })
    clean = pdf.astype(object).where(pdf.notna(), None)
    schema = "agency_std string, title_std string, fiscal_year int, " \
             "median_salary_by_agency double, log_base_salary double, base_salary double"
    df = spark.createDataFrame(clean.to_dict("records"), schema)
    return df, pdf


def design(pdf):
    """One-hot columns and standardised numbers, as the preprocessing should build them."""
    hot = [(pdf.agency_std == v) for v in sorted(pdf.agency_std.unique())]
    hot += [(pdf.title_std.fillna("nan") == v) for v in sorted(pdf.title_std.fillna("nan").unique())]
    numbers = []
    for c in ("fiscal_year", "median_salary_by_agency"):
        x = pdf[c].fillna(pdf[c].median()).to_numpy(float)
        numbers.append((x - x.mean()) / x.std())
    return np.column_stack([np.asarray(h, float) for h in hot] + numbers)


def ridge(x, y, alpha):
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return w, y.mean() - x.mean(0) @ w


def lasso(x, y, alpha, share=1.0, rounds=400):
    """Coordinate descent; with a share below 1 the rest of the penalty is squared."""
    xc, yc, w = x - x.mean(0), y - y.mean(), np.zeros(x.shape[1])
    for _ in range(rounds):
        for j in range(len(w)):
            rho = (xc[:, j] @ (yc - xc @ w + xc[:, j] * w[j])) / len(y)
            size = (xc[:, j] ** 2).mean() + alpha * (1 - share)
            w[j] = np.sign(rho) * max(abs(rho) - alpha * share, 0) / (size or 1)
    return w, y.mean() - x.mean(0) @ w


def test_penalised_fits_on_cells_equal_fits_on_records(data):
    df, pdf = data
    setup = models.prepare(df)
    assert setup.training.count() < 100
    x, y = design(pdf), pdf.log_base_salary.to_numpy()
    for kind, alpha, (w, b) in (("ridge", 7.0, ridge(x, y, 7.0)),
                                ("lasso", 0.01, lasso(x, y, 0.01)),
                                ("elasticnet", 0.01, lasso(x, y, 0.01, 0.5))):
        model = models.train_model(kind, setup, alpha)
        predicted = x @ model.coefficients.toArray() + model.intercept
        assert np.abs(predicted - (x @ w + b)).max() < 1e-4
        if kind == "ridge":
            assert np.abs(model.coefficients.toArray() - w).max() < 1e-4


def test_metrics_on_counts_equal_metrics_on_records(data):
    df, pdf = data
    setup = models.prepare(df)
    model = models.train_model("linear", setup)
    scored = setup.pipeline(model).transform(df)
    by_row = scoring.regression_metrics(scored, F.col("log_base_salary"), F.col("prediction")).first()
    by_count = setup.evaluate(model, df).first()
    for name in ("rows", "r2", "rmse", "mae"):
        assert by_count[name] == pytest.approx(by_row[name], rel=1e-9)
    least, *_ = np.linalg.lstsq(np.column_stack([design(pdf), np.ones(len(pdf))]),
                                pdf.log_base_salary, rcond=None)
    residual = pdf.log_base_salary - np.column_stack([design(pdf), np.ones(len(pdf))]) @ least
    assert by_row.rmse == pytest.approx(np.sqrt((residual**2).mean()), rel=1e-4)


def test_unknown_categories_are_all_zeros(spark, data):
    df, _ = data
    setup = models.prepare(df)
    strange = df.limit(1).withColumns({"agency_std": F.lit("new"), "title_std": F.lit("new")})
    vector = setup.preprocessor.transform(strange).first().features.toArray()
    assert len(vector) == 10 and not vector[:8].any()


def test_tuning_finds_the_best_of_the_grid(data, monkeypatch):
    df, pdf = data
    monkeypatch.setattr(tuning, "ALPHA_POINTS", 3)
    setup = models.prepare(df)
    folded = tuning.folded_cells(setup, df, 3)
    assert folded.agg(F.sum("_count")).first()[0] == len(pdf)
    best = tuning.tune_alphas(folded, 3, ["ridge", "lasso"])["ridge"]
    assert best["best_alpha"] in tuning.alphas("ridge") and best["best_alpha"] < 100
    assert best["best_cv_r2"] > 0.8
    checked, = tuning.cross_validate(folded, 3, {"ridge": best["best_alpha"]})
    assert checked["mean_r2"] == pytest.approx(best["best_cv_r2"])
    boosted = tuning.tune_boosting(folded, 3, [{"maxIter": 2, "maxDepth": 2},
                                               {"maxIter": 8, "maxDepth": 3}])
    assert boosted["maxIter"] == 8


def test_grid_and_draws():
    assert tuning.alphas("ridge")[0] == pytest.approx(1e-3)
    assert tuning.alphas("lasso")[-1] == pytest.approx(10.0) and len(tuning.alphas("lasso")) == 10
    points = tuning.draws()
    assert len(points) == 4 and points == tuning.draws()


def test_trees_learn(data, monkeypatch):
    df, _ = data
    monkeypatch.setitem(models.FOREST, "numTrees", 10)
    monkeypatch.setitem(models.BOOSTING, "maxIter", 10)
    setup = models.prepare(df)
    for kind in ("rf", "gbt"):
        assert setup.evaluate(models.train_model(kind, setup), df).first().r2 > 0.7


def test_importance_names_follow_the_vector(spark, data):
    df, pdf = data
    setup = models.prepare(df)
    model = models.train_model("ridge", setup, 7.0)
    table = models.feature_importance(spark, model, setup.training)
    found = {r.feature: r.coefficient for r in table.collect()}
    w, _ = ridge(design(pdf), pdf.log_base_salary.to_numpy(), 7.0)
    names = ["agency_std_a0", "agency_std_a1", "agency_std_a2", "title_std_nan", "title_std_t0",
             "title_std_t1", "title_std_t2", "title_std_t3", "fiscal_year",
             "median_salary_by_agency"]
    assert found == pytest.approx(dict(zip(names, w)), abs=1e-4)
    groups = {r.category: r for r in models.importance_by_category(table).collect()}
    assert groups["Title"].features == 5 and groups["Year/Fiscal"].features == 1
    assert groups["Agency"].features == 3 and groups["Salary Stats"].features == 1
    positive = models.top_features(table, 3, sign=1)
    assert positive.where("coefficient <= 0").count() == 0 and positive.count() == 3


def test_saved_models_can_be_ranked_and_used(spark, data):
    df, _ = data
    folder = session.scratch_path(spark, "models")
    assert models.load_registry(spark, folder) is None
    setup = models.prepare(df)
    pipeline = setup.pipeline(models.train_model("ridge", setup))
    models.save_model(spark, pipeline, folder, "ridge", test_r2=0.7)
    models.save_model(spark, pipeline, folder, "linear")
    best = scoring.best_model(models.load_registry(spark, folder)).first()
    assert best.name == "ridge"
    scored = PipelineModel.load(best.path).transform(df)
    assert "prediction" in scored.columns
    found = models.predict(PipelineModel.load(best.path), df, 2016)
    assert 0 < found.count() == df.where("fiscal_year = 2016").count()
    assert found.agg(F.avg(F.abs("salary_error_pct")).alias("e")).first().e < 30


def test_models_are_compared_on_distinct_inputs_in_one_pass(data):
    df, _ = data
    setup = models.prepare(df)
    found = models.train_linear(setup, {"ridge": 7.0, "lasso": 0.01})
    test = df.unionByName(df.limit(5).withColumn("log_base_salary", F.lit(None).cast("double")))
    by_model = {row.model: row for row in setup.compare(found, test).collect()}
    assert list(by_model) == ["ridge", "lasso"]
    for kind, model in found.items():
        scored = setup.pipeline(model).transform(df)
        by_row = scoring.regression_metrics(scored, F.col("log_base_salary"), F.col("prediction")).first()
        for name in ("rows", "r2", "rmse", "mae"):
            assert by_model[kind][name] == pytest.approx(by_row[name], rel=1e-9)
    inputs = [*setup.categorical, *setup.numeric]
    said = setup.predictions(found, test)
    assert said.count() == df.select(*inputs).distinct().count()
    assert setup.compare(found, df.limit(0)).count() == 2


def test_searches_share_their_folds(tables, monkeypatch):
    made, told = [], {"best_cv_r2": 0.0}
    monkeypatch.setattr(registry, "_TUNED", {})
    monkeypatch.setattr(registry, "_FOLDED", {})
    monkeypatch.setattr(registry, "_setup", lambda t: None)
    monkeypatch.setattr(tuning, "folded_cells", lambda setup, df, k: made.append(k) or len(made))
    monkeypatch.setattr(tuning, "tune_alphas", lambda folded, k, kinds: {kind: {"on": folded} for kind in kinds})
    monkeypatch.setattr(tuning, "tune_boosting", lambda folded, k: {"on": folded, **told})
    assert {registry._tuned(tables, kind)["on"] for kind in ("ridge", "gbt", "lasso")} == {1}
    assert made == [3]
