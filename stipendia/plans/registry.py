"""Registered queries by name. Each takes (spark, folder of the given tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stipendia import session
from stipendia.ml import models, tuning
from stipendia.operators.ranks import row_mark
from stipendia.operators.tall import tall, tall_row
from stipendia.plans import (
    anomaly, benchmark, clean, features, increments, overtime, profile, recipes, scoring, sketches, tenure, workforce,
)
from stipendia.schema import EMPLOYEE_ORDER, NUMERIC_COLUMNS, PAY_COLUMNS, RAW_TYPES
from stipendia.sources import payroll, rejects, sinks, starschema


# Where the stages of a folder were written in this application, and their schema.
_WRITTEN: dict[tuple[str, str, str], tuple[str, StructType]] = {}
_CSV: dict[tuple[str, str], str] = {}


def stage(*partitions: str):
    """A table that is written to the shared folder when first asked for, and then read.

    These are the files that programs of a payroll pipeline hand to each other: standard
    records, the analysis population, features, reference table and yearly panel, each made from the one before. They are
    built once per application; all queries start from them.
    """
    return lambda build: property(stage_of(*partitions)(build))


def stage_of(*partitions: str):
    """A stored table made from the stages, written when first asked for."""
    def decorate(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def table(t: Tables) -> DataFrame:
            key = (t.spark.sparkContext.applicationId, t.folder, build.__name__)
            if key not in _WRITTEN or not session.exists(t.spark, _WRITTEN[key][0]):
                _WRITTEN[key] = session.staged(build(t), build.__name__.strip("_"), *partitions)
            path, schema = _WRITTEN[key]
            return t.spark.read.schema(schema).parquet(path)

        return table

    return decorate


class Tables:
    """The payroll tables over one folder of given tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = session.tune(spark), folder

    @property
    def raw(self) -> DataFrame:
        """The records as they come; a source of its own, so it is not copied."""
        return starschema.payroll_raw(self.spark, self.folder)

    @property
    def located(self) -> DataFrame:
        return clean.located(self.raw.distinct())

    @stage()
    def standard(self) -> DataFrame:
        return clean.standard_payroll(self.raw)

    @property
    def clean(self) -> DataFrame:
        return clean.analysis_years(clean.annual(self.standard))

    @stage()
    def population(self) -> DataFrame:
        return clean.meaningful_employment(self.clean)

    @stage()
    def model(self) -> DataFrame:
        return features.model_population(self.population)

    @property
    def csv(self) -> str:
        """The records as CSV with human column names, written once."""
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in _CSV or not session.exists(self.spark, _CSV[key]):
            path = session.scratch_path(self.spark, "payroll-csv")
            raw = self.raw
            sinks.write_csv(raw.toDF(*[c.replace("_", " ").title() for c in raw.columns]), path)
            _CSV[key] = path
        return _CSV[key]

    @stage("split")
    def features(self) -> DataFrame:
        return features.feature_table(self.model)

    @property
    def train(self) -> DataFrame:
        return features.split_of(self.features, "train")

    @stage()
    def reference(self) -> DataFrame:
        return features.reference_table(self.train)

    @property
    def training(self) -> DataFrame:
        return features.with_reference(self.features, self.reference)

    @stage()
    def panel(self) -> DataFrame:
        return features.yoy_summary(self.features)

    @property
    def requests(self) -> DataFrame:
        """A request for every known (title, agency), and one per title at an unknown agency.

        Names are written as a user might, in upper case and with extra blanks.
        """
        title, agency = F.col("title_std"), F.col("agency_std")

        def written(c: Column) -> Column:
            return F.concat(F.lit("  "), F.upper(c), F.lit(" "))

        known = self.features.groupBy("title_std", "agency_std").agg(F.count("*").alias("n"))
        asked = known.select(
            F.concat_ws(" @ ", title, agency).alias("request_id"), written(title).alias("title"),
            written(agency).alias("agency"), (F.col("n") % 41).cast("int").alias("tenure_years"),
        )
        unknown = self.features.select("title_std").distinct().select(
            F.concat_ws(" @ ", title, F.lit("nowhere")).alias("request_id"),
            written(title).alias("title"), F.lit("Office  of Nowhere").alias("agency"),
            F.lit(5).alias("tenure_years"),
        )
        return asked.unionByName(unknown)

    @property
    def inputs(self) -> DataFrame:
        categories = features.title_category_map(self.train)
        return benchmark.benchmark_requests(self.requests, self.reference, categories)

    @property
    def predicted(self) -> DataFrame:
        """Test rows with the fallback estimate, the median of the title."""
        return features.split_of(self.training, "test").withColumn(
            "predicted_log_salary", F.ln("median_salary_by_title"))


# Whole numbers that may be missing are shown as doubles, as data frames elsewhere hold them.
GAPPY = {"payroll_number", "agency_title_count", "count_of_job_titles", "current_year"}


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to four digits and dates to text: values two engines can agree on."""
    def show(name: str, kind: str):
        c = F.col(name)
        if name in GAPPY:
            c = c.cast("double")
        elif kind == "double":
            c = F.round(c, digits) + F.lit(0.0)
        elif kind == "date":
            c = c.cast("string")
        return c.alias(name)

    return df.select(*[show(*pair) for pair in df.dtypes])


Query = Callable[[SparkSession, str], DataFrame]


def on(stage: str, plan: Callable[..., DataFrame], *args, **options) -> Query:
    """A plan applied to one stage."""
    return at(lambda t: plan(getattr(t, stage), *args, **options))


def at(plan: Callable[[Tables], DataFrame]) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(plan(Tables(spark, folder)))

    return query


def _load_payroll(t: Tables) -> DataFrame:
    return payroll.load_payroll(t.spark, t.csv)


def _write_splits(t: Tables) -> DataFrame:
    """Write the split tables and the reference table, and count what can be read back."""
    folder = session.scratch_path(t.spark, "splits")
    sinks.write_splits(t.training, t.reference, folder)
    parts = payroll.load_splits(t.spark, f"{folder}/splits")
    reference = payroll.load_optional(t.spark, f"{folder}/reference")
    counted = [p.groupBy(F.col("split").alias("part")).agg(F.count("*").alias("records"))
               for p in parts]
    counted.append(reference.agg(F.lit("reference").alias("part"), F.count("*").alias("records")))
    first, *others = counted
    for part in others:
        first = first.unionByName(part)
    return first


def _split_columns(t: Tables) -> DataFrame:
    """Named columns of the stored splits of the first two parts; a third one does not exist, and one of the
    columns is in none of them."""
    folder = session.scratch_path(t.spark, "splits")
    for name in ("train", "valid"):
        features.split_of(t.features, name).write.parquet(f"{folder}/{name}")
    return payroll.load_columns(t.spark, [f"{folder}/{n}" for n in ("train", "valid", "absent")],
                                ["fiscal_year", "agency_std", "title_std", "base_salary", "not_there"])


def _varying_features(t: Tables) -> DataFrame:
    """The model numbers that are left when constant ones are dropped, with their number of values."""
    train = features.split_of(t.training, "train").select(*MODEL_NUMBERS)
    left = recipes.drop_constant(train, MODEL_NUMBERS)
    counts = left.agg(*[F.count(c).alias(f"{c}__records") for c in left.columns])
    return tall_row(counts, left.columns, ["records"])


def _deliveries(t: Tables) -> DataFrame:
    """Records up to 2022, then 2021 and later ones, then all: offered and newly stored rows of each delivery."""
    store = session.scratch_path(t.spark, "records")
    year = F.col("fiscal_year")
    deliveries = [t.raw.where(year <= 2022), t.raw.where(year >= 2021), t.raw]
    for number, rows in enumerate(deliveries, 1):
        increments.add_records(store, rows, number)
    return increments.stored_records(t.spark, store).groupBy("batch", "fiscal_year").agg(
        F.count("*").alias("records"), F.sum("total_ot_paid").alias("ot_paid"))


def _refreshed_panel(t: Tables) -> DataFrame:
    """The panel of features in which 2019 was wrong and 2021 was missing, after both were put right."""
    store = session.scratch_path(t.spark, "panel")
    year, salary = F.col("fiscal_year"), F.col("base_salary")
    wrong = t.features.where(year != 2021).withColumn(
        "base_salary", F.when(year == 2019, salary * 2).otherwise(salary))
    increments.write_panel(store, wrong)
    increments.refresh_panel(store, t.features, [2019, 2021])
    return t.spark.read.parquet(store)


def _damaged(t: Tables) -> DataFrame:
    """The records as lines without a header. By payroll number some lost their last field, some have one too
    many, and some have words in place of numbers."""
    mark = F.coalesce(F.col("payroll_number") % 97, F.lit(0))
    names = list(RAW_TYPES)
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names}
    texts["base_salary"] = F.when(mark == 4, "n/a").otherwise(texts["base_salary"])
    texts["regular_hours"] = F.when(mark == 5, "8 hours").otherwise(texts["regular_hours"])
    whole = F.concat_ws(",", *[texts[c] for c in names])
    cut = F.concat_ws(",", *[texts[c] for c in names[:-1]])
    lines = F.when(mark == 1, cut).when(mark == 2, F.concat(whole, F.lit(",0"))).otherwise(whole)
    path = session.scratch_path(t.spark, "payroll-lines")
    t.raw.select(lines.alias("value")).write.text(path)
    return rejects.checked(t.spark, path, names)


def _rejected(t: Tables) -> DataFrame:
    """Faults by column and reason, counted in the stored quarantine table."""
    path = session.scratch_path(t.spark, "quarantine")
    rejects.quarantine(_damaged(t), path)
    return rejects.fault_counts(t.spark.read.parquet(path))


SKETCHED = ["agency_std", "title_std", "title_category", "work_location_borough", "total_compensation"]


@stage_of("fiscal_year")
def _quantile_sketches(t: Tables) -> DataFrame:
    return sketches.quantile_sketches(t.clean, NUMERIC_COLUMNS)


@stage_of("fiscal_year")
def _distinct_sketches(t: Tables) -> DataFrame:
    return sketches.distinct_sketches(t.population, SKETCHED)


def _quantile_errors(t: Tables) -> DataFrame:
    """Whether quartiles of 2016 to 2022 from yearly sketches are within the bound, against the records."""
    years = F.col("fiscal_year").between(2016, 2022)
    found = sketches.merged_quantiles(_quantile_sketches(t).where(years), [0.25, 0.5, 0.75])
    errors = sketches.rank_errors(found, t.clean.where(years), NUMERIC_COLUMNS)
    return errors.select("column_name", "n", "probability", (
        F.col("rank_error") <= sketches.RANK_ERROR).alias("within"))


def _distinct_errors(t: Tables) -> DataFrame:
    """Exact numbers of values of all years and in both 2021 and 2022, and whether the sketches are near them."""
    stored, two = _distinct_sketches(t), F.col("fiscal_year").isin(2021, 2022)
    every = profile.cardinality_profile(t.population, SKETCHED).withColumnRenamed("distinct_values", "exact")
    values = tall(t.population.where(two), SKETCHED, "string", keep=["fiscal_year"]).groupBy(
        "column_name", "value").agg(F.count_distinct("fiscal_year").alias("years"))
    both = values.groupBy("column_name").agg(
        F.count_if((F.col("years") == 2) & F.col("value").isNotNull()).alias("exact"))
    # An intersection is as uncertain as the union it is taken from.
    size = sketches.distinct_in_any(stored.where(two)).withColumnRenamed("distinct_values", "union_values")
    common = sketches.distinct_in_all(stored.where(two)).join(size, "column_name")
    near_both = F.abs(F.col("distinct_values") - F.col("exact")) <= sketches.DISTINCT_ERROR * F.col("union_values")
    near_any = sketches.near(F.col("distinct_values"), F.col("exact"))
    return every.join(sketches.distinct_in_any(stored), "column_name").select(
        F.lit("any year").alias("years"), "column_name", "exact", near_any.alias("near")).unionByName(
        both.join(common, "column_name").select(
            F.lit("2021 and 2022").alias("years"), "column_name", "exact", near_both.alias("near")))


def _joined_agencies(t: Tables) -> DataFrame:
    return features.title_to_agencies(t.reference).withColumn(
        "agencies", F.array_join("agencies", "|"))


def _actual_and_predicted() -> tuple[Column, Column]:
    return F.col("log_base_salary"), F.col("predicted_log_salary")


_KEYS = ["fiscal_year", "agency_std", "title_std", "base_salary", "total_compensation"]


def _write_reports(t: Tables) -> DataFrame:
    """Write the anomaly layouts and the tenure master by name, and count what can be read back."""
    folder = session.scratch_path(t.spark, "reports")
    tables = {
        "anomaly_investigation": anomaly.investigation_table(t.population),
        "anomaly_investigation_notes": anomaly.investigation_notes(t.population),
        "anomaly_investigation_final": anomaly.final_investigation(t.population),
        "tenure_master": tenure.tenure_master(t.population),
    }
    sinks.write_all(tables, folder)
    counted = None
    for name in tables:
        one = t.spark.read.parquet(f"{folder}/{name}").agg(
            F.lit(name).alias("name"), F.count("*").alias("records"))
        counted = one if counted is None else counted.unionByName(one)
    return counted


def _write_metadata(t: Tables) -> DataFrame:
    """Target, model inputs and size of each split as JSON, read back."""
    path = session.scratch_path(t.spark, "metadata")
    categorical, numeric = features.model_columns(t.training)
    sizes = t.training.groupBy("split").agg(F.count("*").alias("records"))
    sinks.write_json(sizes.withColumns({
        "target": F.lit("base_salary"), "log_target": F.lit("log_base_salary"),
        "inputs": F.lit("|".join([*categorical, *numeric]))}), path)
    return t.spark.read.schema(
        "split string, records long, target string, log_target string, inputs string").json(path)


def _estimates(t: Tables) -> DataFrame:
    """A registry of three estimates without a model, scored on the test year."""
    title, agency = F.col("median_salary_by_title"), F.col("median_salary_by_agency")
    named = {"title_median": title, "agency_median": agency, "role_median": (title + agency) / 2}
    each = F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.ln(c).alias("estimate")) for n, c in named.items()
    ])).alias("e")
    rows = t.predicted.select("log_base_salary", each).select("log_base_salary", "e.*")
    scores = scoring.regression_metrics(rows, F.col("log_base_salary"), F.col("estimate"), "name")
    return scores.select("name", F.col("r2").alias("test_r2"),
                         F.lit(None).cast("double").alias("best_cv_r2"))


def _blended(t: Tables) -> DataFrame:
    history = t.train.groupBy("title_std").agg(
        F.round(F.avg("base_salary"), 0).alias("title_avg_salary"))
    rows = benchmark.blended_prediction(t.predicted, F.col("median_salary_by_agency"), history)
    return rows.select(*_KEYS, "tenure_years", "expected_salary", "historical_median",
                       "model_prediction_raw")


def _sample(t: Tables) -> DataFrame:
    numbers = ["base_salary", "total_compensation", "ot_hours", "total_ot_paid",
               "total_other_pay", "regular_hours", "employee_agency_tenure"]
    mark = row_mark(["fiscal_year", "title_category", "work_location_borough", *numbers], numbers)
    return recipes.stratified_sample(t.features, ["title_std", "agency_std"], 0.5, mark)


def _scored(plan, *columns: str) -> Query:
    return at(lambda t: plan(t.predicted, *_actual_and_predicted()).select(*columns))


def _splits(t: Tables) -> list[DataFrame]:
    return [features.split_of(t.training, name) for name in ("train", "valid", "test")]


# Fitted preprocessing per folder, with the training cells and their sums of products.
_FITTED: dict[tuple[str, str], models.Setup] = {}


def _key(t: Tables) -> tuple[str, str]:
    return t.spark.sparkContext.applicationId, t.folder


def _setup(t: Tables) -> models.Setup:
    if _key(t) not in _FITTED:
        _FITTED[_key(t)] = models.prepare(_splits(t)[0])
    return _FITTED[_key(t)]


def _evaluated(t: Tables, *kinds: str) -> DataFrame:
    """Each kind of model trained on the training years and scored on the test year."""
    setup = _setup(t)
    linear = [kind for kind in kinds if kind in models.DEFAULT_ALPHA]
    found = models.train_linear(setup, dict.fromkeys(linear)) if linear else {}
    found.update({kind: models.train_model(kind, setup) for kind in kinds if kind not in found})
    return setup.compare({kind: found[kind] for kind in kinds}, _splits(t)[2])


def _preprocess(t: Tables) -> DataFrame:
    """Number of set entries and the standardised numbers of every training record."""
    setup, vector = _setup(t), vector_to_array("features")
    return setup.preprocessor.transform(_splits(t)[0]).select(
        "fiscal_year", "agency_std", "title_std", "base_salary",
        F.size(F.filter(vector, lambda x: x != 0)).alias("entries_set"),
        F.size(vector).alias("entries"), *[f"{c}__z" for c in setup.numeric])


# Results of searches per folder: each search runs once per application, all on the same folded cells.
_TUNED: dict[tuple, dict] = {}
_FOLDED: dict[tuple[str, str, int], DataFrame] = {}


def _folded(t: Tables, k: int) -> DataFrame:
    if (*_key(t), k) not in _FOLDED:
        _FOLDED[(*_key(t), k)] = tuning.folded_cells(_setup(t), _splits(t)[0], k)
    return _FOLDED[(*_key(t), k)]


def _tuned(t: Tables, kind: str, k: int = 3) -> dict:
    """The best settings of a kind over k folds of the training years; the penalties are searched together."""
    if (*_key(t), kind) not in _TUNED:
        found = {"gbt": tuning.tune_boosting(_folded(t, k), k)} if kind == "gbt" else \
            tuning.tune_alphas(_folded(t, k), k, list(tuning.ALPHA_EXPONENTS))
        _TUNED.update({(*_key(t), name): value for name, value in found.items()})
    return _TUNED[(*_key(t), kind)]


def _tuned_alphas(t: Tables) -> DataFrame:
    rows = [{"model": kind, **_tuned(t, kind)} for kind in tuning.ALPHA_EXPONENTS]
    return t.spark.createDataFrame(rows, "model string, best_alpha double, best_cv_r2 double")


def _tuned_boosting(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([_tuned(t, "gbt")])


def _leaderboard(t: Tables) -> DataFrame:
    """The five models, best on the test year first; the champion is saved and registered.

    Ridge, lasso and boosting are tuned by cross-validation before.
    """
    found = models.train_linear(_setup(t), {
        "linear": None, **{kind: _tuned(t, kind)["best_alpha"] for kind in ("ridge", "lasso")}})
    found["rf"] = models.train_model("rf", _setup(t))
    tuned = {name: value for name, value in _tuned(t, "gbt").items() if name != "best_cv_r2"}
    found["gbt"] = models.train_boosting(_setup(t).binned, **tuned)
    scores = {row.model: row for row in _setup(t).compare(found, _splits(t)[2]).collect()}
    best = max(scores, key=lambda kind: scores[kind].r2)
    models.save_model(t.spark, _setup(t).pipeline(found[best]),
                      session.scratch_path(t.spark, "champion"), best, test_r2=scores[best].r2)
    return scoring.leaderboard(t.spark.createDataFrame(
        list(scores.values()), "model string, rows long, r2 double, rmse double, mae double"))


def _group_validated(t: Tables, k: int = 5) -> DataFrame:
    folded = tuning.group_folded_cells(_setup(t), _splits(t)[1], k, *recipes.STRATUM)
    rows = tuning.cross_validate(folded, k, {"ridge": None, "lasso": None})
    return t.spark.createDataFrame(rows, "model string, mean_r2 double, std_r2 double")


def _cross_validated(t: Tables, k: int = 5) -> DataFrame:
    folded = tuning.folded_cells(_setup(t), _splits(t)[1], k)
    rows = tuning.cross_validate(folded, k, dict.fromkeys(models.DEFAULT_ALPHA))
    return t.spark.createDataFrame(rows, "model string, mean_r2 double, std_r2 double")


def _importance(t: Tables) -> DataFrame:
    model = models.train_model("linear", _setup(t))
    return models.feature_importance(t.spark, model, _setup(t).training)


# Where the models of a folder were saved in this application.
_MODELS: dict[tuple[str, str], str] = {}


def _saved(t: Tables) -> DataFrame:
    """The registry of the linear family, fitted once, saved and scored on the test year."""
    if _key(t) not in _MODELS or not session.exists(t.spark, _MODELS[_key(t)]):
        folder = session.scratch_path(t.spark, "models")
        found = models.train_linear(_setup(t), dict.fromkeys(models.DEFAULT_ALPHA))
        for score in _setup(t).compare(found, _splits(t)[2]).collect():
            models.save_model(t.spark, _setup(t).pipeline(found[score.model]), folder, score.model, test_r2=score.r2)
        _MODELS[_key(t)] = folder
    return models.load_registry(t.spark, _MODELS[_key(t)])


def _champion(t: Tables) -> PipelineModel:
    """The best saved model, loaded from where the registry says."""
    return PipelineModel.load(scoring.best_model(_saved(t)).first().path)


def _scored_year(t: Tables) -> DataFrame:
    return models.predict(_champion(t), _splits(t)[2], 2024).select(
        *_KEYS, "predicted_log_salary", "predicted_salary", "actual_log_salary", "log_error",
        "salary_error_pct")


def _scored_requests(t: Tables) -> DataFrame:
    """Requests with the champion's salary and its blend with the title's history."""
    history = t.train.groupBy("title_std").agg(
        F.round(F.avg("base_salary"), 0).alias("title_avg_salary"))
    asked = benchmark.guarded(t.inputs.drop("title_avg_salary"))
    scored = models.predict(_champion(t), asked)
    return benchmark.blended_prediction(scored, F.col("predicted_salary"), history)


def _request_trajectories(t: Tables) -> DataFrame:
    return benchmark.salary_trajectory(
        _scored_requests(t), t.panel, F.col("expected_salary"))


def _validated_trees(t: Tables, k: int = 3) -> DataFrame:
    folded = tuning.folded_cells(_setup(t), _splits(t)[1], k)
    rows = tuning.cross_validate(folded, k, {"rf": None, "gbt": None})
    return t.spark.createDataFrame(rows, "model string, mean_r2 double, std_r2 double")


def _top(count: int, sign: int = 0) -> Query:
    return at(lambda t: models.top_features(_importance(t), count, sign))


MODEL_NUMBERS = ["fiscal_year", "tenure_years", "title_frequency", "agency_size",
                 "median_salary_by_title", "median_salary_by_agency", "count_of_job_titles",
                 "current_year"]

QUERIES: dict[str, Query] = {
    # profile
    "load_payroll": at(_load_payroll),
    "dedup_report": on("raw", profile.dedup_report),
    "missing_profile": on("raw", profile.missing_profile),
    "numeric_profile": on("clean", profile.numeric_profile, NUMERIC_COLUMNS),
    "cardinality_profile": on("raw", profile.cardinality_profile, list(RAW_TYPES)),
    "top_values": on("clean", profile.top_values, [
        "agency_name", "last_name", "first_name", "agency_start_date", "work_location_borough",
        "title_description"]),
    "leave_status_counts": on("raw", profile.value_shares, clean.STATUS),
    "pay_basis_counts": on("standard", profile.value_shares, "pay_basis"),
    "top_titles": on("standard", profile.value_shares, "title_std", 20),
    "sign_checks": on("located", profile.sign_checks, PAY_COLUMNS),
    "numeric_histograms": on("clean", profile.numeric_histograms, NUMERIC_COLUMNS),
    "head_sample": on("clean", profile.head_sample, EMPLOYEE_ORDER),
    # cleaning and workforce
    "clean_payroll": at(lambda t: t.clean),
    "meaningful_employment": at(lambda t: t.population),
    "borough_clean": on("raw", workforce.borough_clean),
    "borough_share_2014": on("raw", workforce.borough_share),
    "borough_year_pivot": on("standard", workforce.borough_year_pivot),
    "workforce_by_year": on("clean", workforce.workforce_by_year),
    "workforce_trend": on("clean", workforce.workforce_trend),
    "standardization_effect": on("standard", workforce.standardization_effect),
    "title_examples": on("standard", workforce.title_examples),
    "title_search": on("standard", workforce.title_search),
    "borough_distribution": on("population", workforce.borough_distribution),
    "borough_hourly_vs_salaried": on("population", workforce.borough_hourly_vs_salaried),
    "low_comp_share": on("clean", workforce.low_comp_share),
    "low_comp_profile": on("clean", workforce.low_comp_profile),
    "hours_buckets": on("clean", workforce.hours_buckets),
    "salaried_by_agency": at(lambda t: profile.value_shares(
        clean.employment_files(t.population)["salaried"], "agency_std", 20)),
    # overtime
    "segment_counts": on("population", overtime.segment_counts),
    "segment_profile": on("population", overtime.segment_profile),
    "ot_overview": on("population", overtime.ot_overview),
    "ot_by_segment": on("population", overtime.ot_by_segment),
    "ot_by_agency": on("population", overtime.ot_by_agency),
    "ot_trend": on("population", overtime.ot_trend),
    "ot_brackets": on("population", overtime.ot_brackets),
    "agency_ot_deep_dive": on("population", overtime.ot_deep_dive),
    "top_ot_agency_per_year": on("population", overtime.top_ot_agency_per_year),
    "ot_change_2021_2022": on("population", overtime.ot_change),
    "headcount_change_2021_2022": on("population", overtime.headcount_change),
    "ot_hours_break": on("population", overtime.ot_hours_break),
    "high_earner_counts": on("population", overtime.high_earner_counts),
    "top_earners": on("population", overtime.top_earners),
    "top_ot_civilian": on("population", overtime.top_ot_civilian),
    # tenure
    "tenure_quality": on("population", tenure.tenure_quality),
    "tenure_validation": on("population", tenure.tenure_validation),
    "tenure_buckets": on("population", tenure.tenure_buckets),
    "new_hires": on("population", tenure.new_hires),
    "new_hire_agencies": on("population", tenure.new_hire_agencies),
    "salary_by_tenure": on("population", tenure.salary_by_tenure),
    "tenure_progression": on("population", tenure.tenure_progression),
    "career_stage": on("population", tenure.career_stage),
    "pay_by_tenure": on("population", tenure.pay_by_tenure),
    "tenure_linear_fit": on("population", tenure.tenure_linear_fit),
    "tenure_correlations": on("population", tenure.tenure_correlations),
    "tenure_agency_extremes": on("population", tenure.tenure_agency_extremes),
    "tenure_agency_chart": on("population", tenure.tenure_agency_extremes, 500),
    "tenure_by_category": on("population", tenure.tenure_by_category),
    "senior_share": on("population", tenure.senior_share),
    "salary_band_by_tenure": on("population", tenure.salary_band_by_tenure),
    "tenure_category_heatmap": on("population", tenure.tenure_category_heatmap),
    "tenure_master": on("population", tenure.tenure_master),
    "tenure_histogram": on("population", tenure.tenure_histogram),
    "tenure_percentiles": on("population", tenure.tenure_percentiles),
    # anomalies
    "anomaly_rule_counts": on("population", anomaly.anomaly_rule_counts),
    "anomaly_scores": on("population", anomaly.anomaly_scores),
    "anomaly_priorities": on("population", anomaly.anomaly_priorities),
    "priority_anomalies": on("population", anomaly.priority_anomalies),
    "investigation_table": on("population", anomaly.investigation_table),
    "investigation_notes": on("population", anomaly.investigation_notes),
    "investigation_final": on("population", anomaly.final_investigation),
    "investigation_note_counts": on("population", anomaly.note_counts),
    "agency_anomaly_rate": on("population", anomaly.agency_anomaly_rate),
    # features
    "model_population": at(lambda t: t.model),
    "temporal_split": on("model", features.temporal_split),
    "tenure_proxy": on("model", features.tenure_proxy),
    "frequency_features": on("model", features.frequency_features),
    "rare_titles": on("model", features.rare_titles),
    "overtime_features": at(lambda t: features.with_overtime_features(t.model).groupBy(
        "fiscal_year", "has_ot").agg(F.count("*").alias("records"),
                                     F.sum("ot_hours_total").alias("ot_hours_total"))),
    "feature_table": at(lambda t: t.features),
    "reference_table": at(lambda t: t.reference),
    "reference_features": at(lambda t: t.training),
    "yoy_summary": at(lambda t: t.panel),
    "title_category_map": on("train", features.title_category_map),
    "title_agency_totals": on("reference", features.title_agency_totals),
    "title_to_agencies": at(_joined_agencies),
    "write_splits": at(_write_splits),
    "write_reports": at(_write_reports),
    "write_metadata": at(_write_metadata),
    # benchmarks and scores
    "requests_without_reference": at(
        lambda t: benchmark.requests_without_reference(t.requests, t.reference)),
    "benchmark_requests": at(lambda t: t.inputs),
    "yoy_growth": at(lambda t: benchmark.yoy_growth(t.inputs, t.panel)),
    "salary_cagr": on("panel", benchmark.salary_cagr),
    "salary_trajectory": at(lambda t: benchmark.salary_trajectory(t.inputs, t.panel)),
    "median_histogram": on("reference", benchmark.median_histogram, "teacher"),
    "blended_prediction": at(_blended),
    "regression_metrics": _scored(scoring.regression_metrics, "rows", "r2", "rmse", "mae"),
    "score_with_errors": at(lambda t: scoring.score_with_errors(t.predicted).select(
        *_KEYS, "predicted_log_salary", "predicted_salary", "actual_log_salary", "log_error",
        "salary_error_pct")),
    "ranked_models": at(lambda t: scoring.ranked_models(_estimates(t)).select("name", "r2_score")),
    "best_model": at(lambda t: scoring.best_model(_estimates(t)).select("name", "r2_score")),
    "prediction_interval": _scored(scoring.prediction_interval, *_KEYS, "predicted_log_salary",
                                   "lower_bound", "upper_bound"),
    "error_by_range": _scored(scoring.error_by_range, "salary_range", "records", "mean_error"),
    # models
    "preprocess_features": at(_preprocess),
    "train_linear_family": at(lambda t: _evaluated(t, *models.DEFAULT_ALPHA)),
    "train_forest": at(lambda t: _evaluated(t, "rf")),
    "train_gbt": at(lambda t: _evaluated(t, "gbt")),
    "tune_alpha": at(_tuned_alphas),
    "tune_gbt": at(_tuned_boosting),
    "cross_validate": at(_cross_validated),
    "group_cross_validate": at(_group_validated),
    "model_leaderboard": at(_leaderboard),
    "feature_importance": at(_importance),
    "cross_validate_trees": at(_validated_trees),
    "model_registry": at(lambda t: scoring.ranked_models(_saved(t)).select("name", "r2_score")),
    "score_test_year": at(_scored_year),
    "score_requests": at(lambda t: _scored_requests(t).select(
        "request_id", "agency_std", "title_std", "tenure_years", "predicted_log_salary",
        "expected_salary", "historical_median", "model_prediction_raw")),
    "request_trajectory": at(_request_trajectories),
    "top_features": _top(20),
    "top_features_50": _top(50),
    "top_positive_features": _top(15, 1),
    "top_negative_features": _top(15, -1),
    "importance_by_category": at(lambda t: models.importance_by_category(_importance(t))),
    # recipes
    "year_relative_salary": at(lambda t: recipes.year_relative_salary(t.features).select(
        "fiscal_year", "agency_std", "title_std", "base_salary", "salary_vs_year_mean",
        "salary_vs_year_median", "salary_std_by_year", "salary_percentile_by_year",
        "salary_z_score_by_year", "salary_deviation_from_year_mean")),
    "stratified_sample": at(_sample),
    "min_stratum": on("features", recipes.min_stratum),
    "borough_category_cube": on("features", recipes.borough_category_cube),
    "split_strata_report": on("features", recipes.split_strata_report),
    "interaction_features": at(lambda t: recipes.interaction_features(t.features).select(
        "fiscal_year", "agency_std", "title_std", "base_salary", "tenure_years", "tenure_squared",
        "tenure_cubed", "tenure_x_agency_size", "tenure_x_title_freq", "agency_size_x_title_freq",
        "log_agency_size", "sqrt_tenure")),
    "job_seniority": at(lambda t: recipes.job_seniority(t.features).groupBy(
        "title_std", "job_seniority").agg(F.count("*").alias("records"))),
    "borough_cola": at(lambda t: recipes.borough_cola(t.features).groupBy(
        "work_location_borough", "borough_cola").agg(F.count("*").alias("records"))),
    "agency_prestige": on("features", recipes.agency_prestige),
    "split_columns": at(_split_columns),
    "rejected_records": at(_rejected),
    "accepted_records": at(lambda t: rejects.accepted(_damaged(t))),
    "incremental_records": at(_deliveries),
    "refreshed_panel": at(_refreshed_panel),
    "varying_features": at(_varying_features),
    "coefficient_threshold": at(lambda t: models.above_threshold(_importance(t))),
    "quantile_sketches": at(_quantile_errors),
    "distinct_sketches": at(_distinct_errors),
    "heavy_hitters": on("clean", sketches.heavy_hitters, SKETCHED[:4]),
    "variance_report": at(lambda t: recipes.variance_report(
        features.split_of(t.training, "train"), MODEL_NUMBERS)),
}
