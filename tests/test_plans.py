"""Invariants of the plans, and marts on literal rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from stipendia import session
from stipendia.ml import models
from stipendia.plans import anomaly, benchmark, clean, features, overtime, recipes, scoring
from stipendia.sources import payroll, sinks, synthetic


def same_rows(a, b):
    b = b.select(a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_one_shuffle_population_equals_two_step_cleaning(tables):
    two_steps = clean.meaningful_employment(clean.clean_payroll(tables.raw))
    same_rows(tables.population, two_steps)
    assert tables.population.count() > 0


def test_segments_and_splits_are_disjoint_and_complete(tables):
    counted = overtime.segment_counts(tables.population).agg(F.sum("records")).first()[0]
    assert counted == tables.population.count()
    split = features.temporal_split(tables.model).agg(F.sum("records")).first()[0]
    assert split == tables.model.count() == tables.features.count()


def test_population_without_optional_columns(spark):
    df = spark.createDataFrame(
        [("x", 20_000.0, "t"), ("x", 20_000.0, "t"), (None, 9_999.0, "t")],
        "agency_std string, base_salary double, note string")
    found = features.model_population(df)
    assert found.columns == ["agency_std", "base_salary"] and found.count() == 1
    assert features.tenure_proxy(found).first().tenure_years == 0


def test_every_combination_of_rules_is_scored(spark):
    rows = list(itertools.product((False, True), repeat=4))
    df = spark.createDataFrame(rows, ", ".join(f"{r} boolean" for r in anomaly.WEIGHTS))
    score = sum((F.col(r).cast("int") * w for r, w in anomaly.WEIGHTS.items()), F.lit(0))
    found = df.select(*anomaly.WEIGHTS, score.alias("s")).select(
        "*", anomaly.priority(F.col("s")).alias("p")).collect()
    for r in found:
        expected = 3 * r[0] + 2 * r[1] + 2 * r[2] + r[3]
        label = ("CRITICAL" if expected >= 5 else "HIGH" if expected >= 4
                 else "MEDIUM" if expected >= 3 else "LOW")
        assert r.s == expected and r.p.startswith(label)


def test_titles_need_more_than_ten_records(spark):
    rows = [("ten", float(i)) for i in range(10)] + [("eleven", float(i)) for i in range(11)]
    df = spark.createDataFrame(rows, "title_std string, base_salary double")
    assert [r.title_std for r in anomaly.title_thresholds(df).collect()] == ["eleven"]


PANEL = "title_std string, agency_std string, fiscal_year int, base_salary double, " \
        "headcount long, regular_hours double"


def panel(spark, *rows):
    return spark.createDataFrame([("t", a, y, s, n, h) for a, y, s, n, h in rows], PANEL)


def test_growth_needs_both_years_and_a_base(spark):
    inputs = spark.createDataFrame([("1", "t", "a"), ("2", "t", "b"), ("3", "t", "z")],
                                   "request_id string, title_std string, agency_std string")
    rows = panel(spark, ("a", 2023, 100.0, 4, 0.0), ("a", 2024, 110.0, 2, 9.0),
                 ("b", 2022, 50.0, 1, 1.0), ("b", 2024, 90.0, 1, 1.0))
    found = {r.request_id: r for r in benchmark.yoy_growth(inputs, rows).collect()}
    assert found["1"].agency_growth == pytest.approx(10.0)
    assert found["1"].headcount_growth == -50.0 and found["1"].hours_growth is None
    assert found["2"].agency_growth is None and found["3"].agency_growth is None
    assert found["2"].title_growth == pytest.approx(0.0)


def test_trajectory(spark):
    inputs = spark.createDataFrame(
        [("none", "t", "z", 100.0), ("one", "t", "b", 100.0), ("two", "t", "a", 100.0)],
        "request_id string, title_std string, agency_std string, median_salary_by_title double")
    rows = panel(spark, ("a", 2020, 100.0, 1, 1.0), ("a", 2022, 121.0, 1, 1.0),
                 ("b", 2022, 50.0, 1, 1.0))
    found = benchmark.salary_trajectory(inputs, rows)
    future = {(r.request_id, r.fiscal_year): r
              for r in found.where("kind = 'Projected'").collect()}
    assert len(future) == 18 and found.where("kind <> 'Projected'").count() == 3
    assert future["none", 2025].salary == pytest.approx(102.0)
    assert future["one", 2028].upper == pytest.approx(100 * 1.02**4 + 10 * 4**0.5)
    assert future["two", 2026].salary == pytest.approx(121.0)
    assert future["two", 2024].lower == future["two", 2024].upper == 100.0


def test_registry_order(spark):
    rows = [("a", None, None, 0.4), ("b", None, 0.9, None), ("linear", None, None, None)]
    df = spark.createDataFrame(rows, "name string, test_r2 double, best_cv_r2 double, r2 double")
    assert [r.name for r in scoring.ranked_models(df).collect()] == ["b", "a", "linear"]
    assert scoring.best_model(df).first().name == "b"
    assert scoring.best_model(df.where("name = 'linear'")).first().name == "linear"


def test_blend_without_history_is_the_model(spark):
    df = spark.createDataFrame([("t", 30, 100.0), ("u", 3, 100.0)],
                               "title_std string, tenure_years int, m double")
    history = spark.createDataFrame([("t", 200.0)], "title_std string, title_avg_salary double")
    found = {r.title_std: r for r in benchmark.blended_prediction(df, F.col("m"), history).collect()}
    assert (found["t"].expected_salary, found["t"].tenure_years) == (130.0, 20)
    assert (found["u"].expected_salary, found["u"].historical_median) == (100.0, 0.0)
    assert found["u"].pay_basis == "annual" and found["u"].regular_hours_worked == 40


def test_files(spark, tables, tmp_path):
    assert payroll.snake("  Leave Status (as of)__June 30! ") == "leave_status_as_of_june_30"
    assert payroll.load_optional(spark, str(tmp_path / "nothing")) is None
    sinks.write_all(clean.employment_files(tables.population), str(tmp_path))
    parts = [spark.read.parquet(str(tmp_path / n)).count() for n in ("hourly", "salaried", "combined")]
    assert parts[0] + parts[1] == parts[2] == tables.population.count()
    sinks.write_splits(tables.training, tables.reference, str(tmp_path))
    splits = payroll.load_splits(spark, str(tmp_path / "splits"))
    assert sum(s.count() for s in splits) == tables.training.count()
    both = payroll.load_columns(
        spark, [str(tmp_path / "reference"), str(tmp_path / "absent")], ["title_std"])
    assert both.columns == ["title_std"]
    with pytest.raises(FileNotFoundError):
        payroll.load_columns(spark, [str(tmp_path / "absent")], ["title_std"])
    sinks.write_json(features.title_category_map(tables.train), str(tmp_path / "map"))
    assert spark.read.json(str(tmp_path / "map")).columns == ["title_category", "title_std"]


def test_csv_with_bad_numbers(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("Fiscal Year,Base Salary,Agency Name,Other\n2020,oops,\"A, B\",1\n,7.5,,2\n")
    found = payroll.load_payroll(spark, str(path))
    assert found.dtypes[:2] == [("fiscal_year", "int"), ("base_salary", "double")]
    assert [tuple(r) for r in found.collect()] == [(2020, None, "A, B", "1"), (None, 7.5, None, "2")]


def test_synthetic_payroll(spark):
    df = synthetic.synthetic_payroll(spark)
    described = {r.column_name for r in synthetic.data_dictionary(spark).collect()}
    assert df.count() == 5_000 and set(df.columns) == described
    row = df.agg(F.min("base_salary"), F.max("base_salary"), F.min("fiscal_year"),
                 F.max("fiscal_year")).first()
    assert row[0] >= 30_000 and row[1] <= 250_000 and (row[2], row[3]) == (2015, 2024)
    assert df.exceptAll(synthetic.synthetic_payroll(spark)).count() == 0


def test_features_that_hardly_vary_are_dropped(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0.0, "x"), (2.0, 5.0, 0.1, "y"), (4.0, 5.0, 0.2, None)],
                               "a double, b double, c double, name string")
    # Variances 14/9, 0 and 0.02/3; the last is not above 0.01.
    assert recipes.drop_constant(df, ["a", "b", "c"]).columns == ["a", "name"]
    assert recipes.drop_constant(df, ["a", "b", "c"], 0.001).columns == ["a", "c", "name"]
    assert recipes.drop_constant(df.where("false"), ["a"]).columns == df.columns


def test_coefficients_above_a_threshold(spark):
    table = spark.createDataFrame([("a", 0.06), ("b", -0.2), ("c", 0.05), ("d", 0.0)],
                                  "feature string, coefficient double").withColumn("abs_coefficient", F.abs("coefficient"))
    assert {r.feature for r in models.above_threshold(table).collect()} == {"a", "b"}
    assert {r.feature for r in models.above_threshold(table, 0.1).collect()} == {"b"}


def test_small_tasks_are_set_unless_chosen(spark):
    """Tasks of scans and shuffles are small, so that the different rows of one fit its memory."""
    keys = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"]
    other = spark.newSession()
    for key in keys:
        other.conf.unset(key)
    other.conf.set(keys[1], "48m")
    session.tune(other)
    assert [other.conf.get(key) for key in keys] == ["16m", "48m"]


def test_features_shuffle_no_records(spark, tables):
    """The cells have a known size when they are joined, so the plan has no exchange of the records."""
    model, found = tables.model, features.feature_table(tables.model)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert found.count() == model.join(features.cell_features(model), features.CELL).count()


def test_partitions_are_written_without_a_shuffle(spark, tables):
    context, rows = spark.sparkContext, tables.model
    context.setJobGroup("parts", "parts")
    path, schema = session.staged(rows.withColumn("part", F.col("fiscal_year") % 2), "parts", "part")
    context.setLocalProperty("spark.jobGroup.id", None)
    status = context.statusTracker()
    jobs = status.getJobIdsForGroup("parts")
    assert [len(status.getJobInfo(j).stageIds) for j in jobs] == [1]
    back = spark.read.schema(schema).parquet(path)
    assert back.where("part = 1").count() == rows.where("fiscal_year % 2 = 1").count()
