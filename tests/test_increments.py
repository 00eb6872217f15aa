"""Deliveries and corrections against a rebuild from everything, and damaged files."""

import os

import pytest
from pyspark.sql import functions as F

from stipendia.plans import increments
from stipendia.sources import payroll, rejects


def same_rows(a, b):
    b = b.select(a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


ROWS = "fiscal_year int, name string, salary double"
FIRST = [(2020, "a", 1.0), (2020, "a", 1.0), (2021, None, 2.0), (2021, "", 2.0), (2021, "a|1:b", None)]
SECOND = [(2022, "a", 1.0), (2021, None, 2.0), (2022, "a", 1.0), (None, None, None), (None, None, None)]


def test_deliveries_equal_distinct_over_all(spark, tmp_path):
    store = str(tmp_path / "store")
    first, second = spark.createDataFrame(FIRST, ROWS), spark.createDataFrame(SECOND, ROWS)
    increments.add_records(store, first, 1)
    increments.add_records(store, second, 2)
    found = increments.stored_records(spark, store)
    same_rows(found.drop("batch"), first.union(second).distinct())
    assert {r.batch: r["count"] for r in found.groupBy("batch").count().collect()} == {1: 4, 2: 2}


def test_delivery_added_again_changes_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    first, second = spark.createDataFrame(FIRST, ROWS), spark.createDataFrame(SECOND, ROWS)
    for df, batch in ((first, 1), (second, 2), (second, 2), (first, 1), (first, 3), (second.limit(0), 4)):
        increments.add_records(store, df, batch)
    found = increments.stored_records(spark, store)
    same_rows(found.drop("batch"), first.union(second).distinct())
    assert found.where("batch > 2").count() == 0


def test_delivery_cut_off_before_its_digests(spark, tmp_path):
    store = str(tmp_path / "store")
    first, second = spark.createDataFrame(FIRST, ROWS), spark.createDataFrame(SECOND, ROWS)
    increments.add_records(store, first, 1)
    second.withColumn("_digest", increments.row_digest(second.columns)).write.parquet(
        f"{store}/records/batch=2")
    increments.add_records(store, second, 2)
    same_rows(increments.stored_records(spark, store).drop("batch"), first.union(second).distinct())


def test_delivery_without_news_shuffles_digests_only(spark, tmp_path, monkeypatch):
    """Nothing is written beside the records, and rows are joined only to digests that are new."""
    store, fresh = str(tmp_path / "store"), []
    written = increments.session.written
    monkeypatch.setattr(increments.session, "written", lambda df, name: fresh.append(written(df, name)) or fresh[-1])
    first, second = spark.createDataFrame(FIRST, ROWS), spark.createDataFrame(SECOND, ROWS)
    for number, rows in enumerate((first, second, first.union(second)), 1):
        increments.add_records(store, rows, number)
    assert [table.columns for table in fresh] == [["_digest"]] * 2
    assert [table.count() for table in fresh] == [2, 0]
    assert os.listdir(store) == ["records"]
    same_rows(increments.stored_records(spark, store).drop("batch"), first.union(second).distinct())


def test_cells_do_not_run_into_each_other(spark):
    rows = [("a|1:b", "c"), ("a", "b|1:c"), ("~", None), (None, "~"), ("", None), (None, "")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(increments.row_digest(["x", "y"])).distinct().count() == len(rows)


def _files(store):
    return {year: sorted((f, os.stat(f"{store}/{year}/{f}").st_mtime_ns) for f in os.listdir(f"{store}/{year}"))
            for year in os.listdir(store) if year.startswith("fiscal_year=")}


RECORDS = "fiscal_year int, title_std string, agency_std string, base_salary double, regular_hours double"


def records(spark, salary_2021, years=(2019, 2020, 2021, 2022, 2023)):
    rows = [(y, t, a, (salary_2021 if y == 2021 else 50_000.0) + 1000 * i + y, 1800.0)
            for y in years for t, a in (("clerk", "x"), ("nurse", "y"), ("clerk", "y")) for i in range(3)
            if not (t == "nurse" and y == 2020)]
    return spark.createDataFrame(rows, RECORDS)


def test_corrected_year_equals_rebuild_and_leaves_others(spark, tmp_path):
    store = str(tmp_path / "panel")
    increments.write_panel(store, records(spark, 90_000.0))
    before = _files(store)
    corrected = records(spark, 51_000.0)
    increments.refresh_panel(store, corrected, [2021])
    rebuilt = increments.growing_panel(corrected)
    same_rows(spark.read.parquet(store).select(rebuilt.columns), rebuilt)
    after = _files(store)
    same = {year for year in before if before[year] == after[year]}
    assert same == {"fiscal_year=2019", "fiscal_year=2020", "fiscal_year=2023"}


@pytest.mark.parametrize("touched,years", [([2021], (2019, 2020, 2022, 2023)),
                                           ([2023, 2024], (2019, 2020, 2021, 2022, 2023, 2024)),
                                           ([2018], (2018, 2019, 2020, 2021, 2022, 2023))])
def test_years_that_go_and_years_that_come(spark, tmp_path, touched, years):
    store = str(tmp_path / "panel")
    increments.write_panel(store, records(spark, 50_000.0))
    now = records(spark, 50_000.0, years)
    increments.refresh_panel(store, now, touched)
    rebuilt = increments.growing_panel(now)
    same_rows(spark.read.parquet(store).select(rebuilt.columns), rebuilt)


HEADER = "Fiscal Year,Agency Name,Agency Start Date,Base Salary"
LINES = ['2020,"A, B",01/02/2003,100.5', "2020,A,01/02/2003", "2020,A,01/02/2003,1,2", "x20,A,99/99/9999,1e3",
         '2020,,,', '2021,"say ""hi"", then",3/4/2005,n/a', "2021,  ,01/02/2003,  "]


def test_damaged_file(spark, tmp_path):
    (tmp_path / "payroll.csv").write_text("\n".join([HEADER, *LINES]) + "\n")
    checks = rejects.checked(spark, str(tmp_path / "payroll.csv"))
    counts = {(r.column_name, r.reason): r.records for r in rejects.fault_counts(checks).collect()}
    assert counts == {("line", "missing fields"): 1, ("line", "extra fields"): 1, ("fiscal_year", "not int"): 1,
                      ("agency_start_date", "not a date"): 1, ("base_salary", "not double"): 1}
    rows = [tuple(r) for r in rejects.accepted(checks).collect()]
    assert rows[0] == (2020, "A, B", "01/02/2003", 100.5)
    assert rows[1] == (None, "A", "99/99/9999", 1000.0)
    assert rows[3][:3] == (2021, 'say "hi", then', "3/4/2005") and rows[3][3] is None
    assert len(rows) == 5 and rejects.accepted(checks, strict=True).count() == 3
    lines = {r._line for r in rejects.rejected(checks).collect() if r._line}
    assert lines == {LINES[1], LINES[2]}
    path = str(tmp_path / "quarantine")
    rejects.quarantine(checks, path)
    assert spark.read.parquet(path).count() == 4


def test_good_file_is_unchanged(spark, tables):
    checks = rejects.checked(spark, tables.csv)
    same_rows(rejects.accepted(checks), payroll.load_payroll(spark, tables.csv))
    assert rejects.fault_counts(checks).where(F.col("column_name") != "agency_start_date").count() == 0


def test_empty_file_with_header(spark, tmp_path):
    (tmp_path / "payroll.csv").write_text(HEADER + "\n")
    checks = rejects.checked(spark, str(tmp_path / "payroll.csv"))
    assert rejects.accepted(checks).count() == 0 and rejects.fault_counts(checks).count() == 0
