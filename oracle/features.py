from __future__ import annotations

from oracle.base import TABLES, buckets, on, pct, r, shown, title_case

_TEXT = ["agency_std", "title_std", "title_category", "work_location_borough"]


def _clean(column: str) -> str:
    text = f"regexp_replace(coalesce({column}, 'unknown'), '\\s+', ' ', 'g')"
    return f"lower(trim({text})) AS {column}"


SPLIT = """CASE WHEN fiscal_year BETWEEN 2015 AND 2022 THEN 'train' WHEN fiscal_year = 2023 THEN 'valid'
     WHEN fiscal_year = 2024 THEN 'test' END"""

TABLES["model"] = ("population", f"""
SELECT DISTINCT fiscal_year, {', '.join(map(_clean, _TEXT))}, base_salary, total_compensation,
       regular_hours, ot_hours, total_ot_paid, total_other_pay, employee_agency_tenure
FROM population WHERE base_salary BETWEEN 10000 AND 500000""")

TABLES["features"] = ("model", f"""
SELECT * REPLACE (CASE WHEN title_frequency >= 100 THEN title_std ELSE 'other_title' END
                  AS title_std_grouped),
       {buckets('tenure_years', [None, 0, 1, 3, 5, 10, 20, None],
                ['0', '1', '2-3', '4-5', '6-10', '11-20', '20+'])} AS tenure_bucket
FROM (SELECT *, NULL AS title_std_grouped, ln(greatest(base_salary, 1)) AS log_base_salary,
             count(*) OVER (PARTITION BY split, title_std) AS title_frequency,
             count(*) OVER (PARTITION BY split, agency_std) AS agency_size
      FROM (SELECT *, {SPLIT} AS split,
                   fiscal_year - min(fiscal_year) OVER (PARTITION BY agency_std, title_std)
                     AS tenure_years FROM model))
WHERE split IS NOT NULL""")

TABLES["reference"] = ("features", """
SELECT p.*, t.median_salary_by_title, t.count_of_job_titles, a.median_salary_by_agency
FROM (SELECT agency_std, title_std, count(*) AS agency_title_count, max(fiscal_year) AS current_year,
             quantile_cont(regular_hours, 0.5) AS regular_hours
      FROM current_year GROUP BY agency_std, title_std) p
LEFT JOIN (SELECT title_std, quantile_cont(base_salary, 0.5) AS median_salary_by_title,
                  count(*) AS count_of_job_titles FROM current_year GROUP BY title_std) t
  USING (title_std)
LEFT JOIN (SELECT agency_std, quantile_cont(base_salary, 0.5) AS median_salary_by_agency
           FROM current_year GROUP BY agency_std) a USING (agency_std)""".replace(
    "current_year GROUP", """(SELECT * FROM features WHERE split = 'train' AND fiscal_year =
      (SELECT max(fiscal_year) FROM features WHERE split = 'train')) GROUP"""))

TABLES["training"] = ("features reference", """
SELECT f.*, x.* EXCLUDE (agency_std, title_std, regular_hours), x.regular_hours AS ref_regular_hours
FROM features f LEFT JOIN reference x
  ON f.agency_std = x.agency_std AND f.title_std = x.title_std""")

TABLES["panel"] = ("features", """
SELECT fiscal_year, title_std, agency_std, count(base_salary) AS headcount,
       quantile_cont(base_salary, 0.5) AS base_salary,
       quantile_cont(regular_hours, 0.5) AS regular_hours
FROM features GROUP BY fiscal_year, title_std, agency_std""")

TABLES["categories"] = ("features", """
SELECT title_std, title_category FROM (
  SELECT title_std, title_category,
         row_number() OVER (PARTITION BY title_std ORDER BY count(*) DESC, title_category) AS place
  FROM features WHERE split = 'train' GROUP BY title_std, title_category) WHERE place = 1""")

_TENURE = f"{r('employee_agency_tenure')} AS employee_agency_tenure"
_LOG = f"{r('log_base_salary')} AS log_base_salary"
_COUNTS = ["agency_title_count", "count_of_job_titles", "current_year"]
_MODEL = "* EXCLUDE (title_std_grouped, tenure_bucket, log_base_salary, title_frequency, agency_size)"

QUERIES = {
    "model_population": on("model", f"SELECT * REPLACE ({_TENURE}) FROM model"),
    "temporal_split": on("features", """
        SELECT split, count(*) AS records, min(fiscal_year) AS first_year,
               max(fiscal_year) AS last_year FROM features GROUP BY split"""),
    "tenure_proxy": on("features", f"""
        SELECT * EXCLUDE (split) REPLACE ({_TENURE}) FROM (SELECT {_MODEL} FROM features)"""),
    "frequency_features": on("features", f"""
        SELECT * EXCLUDE (title_std_grouped, tenure_bucket, log_base_salary, tenure_years)
               REPLACE ({_TENURE}) FROM features"""),
    "rare_titles": on("features", f"""
        SELECT * EXCLUDE (tenure_bucket, log_base_salary, tenure_years, title_frequency,
                          agency_size) REPLACE ({_TENURE}) FROM features"""),
    "overtime_features": on("model", f"""
        SELECT fiscal_year, CASE WHEN coalesce(ot_hours, 0) > 0 THEN 1 ELSE 0 END AS has_ot,
               count(*) AS records, {r('sum(coalesce(ot_hours, 0))')} AS ot_hours_total
        FROM model GROUP BY 1, 2"""),
    "feature_table": on("features", f"SELECT * REPLACE ({_TENURE}, {_LOG}) FROM features"),
    "reference_table": on("reference", shown("reference", *_COUNTS)),
    "reference_features": on("training", shown(
        "training", "employee_agency_tenure", "log_base_salary", *_COUNTS)),
    "yoy_summary": on("panel", "SELECT * FROM panel"),
    "refreshed_panel": on("panel", f"""
        SELECT p.*, b.base_salary AS prior_salary,
               {pct("p.base_salary - b.base_salary", "b.base_salary")} AS growth_pct
        FROM panel p LEFT JOIN panel b ON b.fiscal_year = p.fiscal_year - 1
             AND b.title_std = p.title_std AND b.agency_std = p.agency_std"""),
    "title_category_map": on("categories", "SELECT * FROM categories"),
    "title_agency_totals": on("reference", """
        SELECT 'title' AS kind, title_std AS key, CAST(sum(agency_title_count) AS BIGINT) AS records
        FROM reference GROUP BY title_std UNION ALL
        SELECT 'agency', agency_std, CAST(sum(agency_title_count) AS BIGINT)
        FROM reference GROUP BY agency_std"""),
    "title_to_agencies": on("reference", f"""
        SELECT title, array_to_string(list_sort(list(DISTINCT agency)), '|') AS agencies
        FROM (SELECT {title_case('title_std')} AS title, {title_case('agency_std')} AS agency
              FROM reference) GROUP BY title"""),
    "write_splits": on("training", """
        SELECT split AS part, count(*) AS records FROM training GROUP BY split
        UNION ALL SELECT 'reference', count(*) FROM reference"""),
}

_NUMBERS = ["base_salary", "total_compensation", "ot_hours", "total_ot_paid", "total_other_pay",
            "regular_hours", "employee_agency_tenure"]


def _digits(column: str) -> str:
    return f"coalesce(CAST(CAST(round({column}, 6) AS DECIMAL(30, 6)) AS VARCHAR), '~')"


# Recipes on the feature table.
STRATUM = "work_location_borough, title_category"
QUERIES.update({
    "year_relative_salary": on("features", f"""
        SELECT f.fiscal_year, f.agency_std, f.title_std, f.base_salary,
               {r('base_salary / mean_')} AS salary_vs_year_mean,
               {r('base_salary / median_')} AS salary_vs_year_median,
               {r('std_')} AS salary_std_by_year,
               {r('(lo + (ties - 1) / 2e0) / n')} AS salary_percentile_by_year,
               {r('(base_salary - mean_) / std_')} AS salary_z_score_by_year,
               {r('base_salary - mean_')} AS salary_deviation_from_year_mean
        FROM (SELECT *, rank() OVER (PARTITION BY fiscal_year ORDER BY base_salary) AS lo,
                     count(*) OVER (PARTITION BY fiscal_year, base_salary) AS ties
              FROM features) f
        JOIN (SELECT fiscal_year, avg(base_salary) AS mean_, stddev_samp(base_salary) AS std_,
                     quantile_cont(base_salary, 0.5) AS median_, count(*) AS n
              FROM features GROUP BY fiscal_year) y USING (fiscal_year)"""),
    "stratified_sample": on("features", f"""
        SELECT * EXCLUDE (m, row_, of_) REPLACE ({_TENURE}, {_LOG}) FROM (
          SELECT *, row_number() OVER (PARTITION BY title_std, agency_std ORDER BY m) AS row_,
                 count(*) OVER (PARTITION BY title_std, agency_std) AS of_
          FROM (SELECT *, md5(concat_ws('|', fiscal_year, coalesce(title_category, '~'),
                  coalesce(work_location_borough, '~'), {', '.join(map(_digits, _NUMBERS))})) AS m
                FROM features))
        WHERE row_ <= round_even(of_ * 0.5e0, 0)"""),
    "min_stratum": on("features", f"""
        SELECT * REPLACE ({_TENURE}, {_LOG}) FROM features
        WHERE ({STRATUM}) IN (SELECT ({STRATUM}) FROM features
                              GROUP BY {STRATUM} HAVING count(*) >= 100)"""),
    "borough_category_cube": on("features", f"""
        SELECT {STRATUM}, count(*) AS records, CAST(grouping({STRATUM}) AS BIGINT) AS margin,
               {pct('count(*)', '(SELECT count(*) FROM features)')} AS pct,
               grouping({STRATUM}) = 0
                 AND 100e0 * count(*) / (SELECT count(*) FROM features) < 0.5 AS rare
        FROM features GROUP BY CUBE ({STRATUM})"""),
    "split_strata_report": on("features", f"""
        SELECT split, count(*) AS strata, quantile_cont(n, 0.5) AS median_size, min(n) AS min_size,
               max(n) AS max_size, {pct('max(n)', 'sum(n)')} AS largest_pct
        FROM (SELECT split, {STRATUM}, count(*) AS n FROM features GROUP BY ALL) GROUP BY split"""),
    "interaction_features": on("features", f"""
        SELECT fiscal_year, agency_std, title_std, base_salary, tenure_years,
               tenure_years * tenure_years AS tenure_squared,
               tenure_years * tenure_years * tenure_years AS tenure_cubed,
               tenure_years * agency_size AS tenure_x_agency_size,
               tenure_years * title_frequency AS tenure_x_title_freq,
               agency_size * title_frequency AS agency_size_x_title_freq,
               {r('ln(1e0 + agency_size)')} AS log_agency_size,
               {r('sqrt(tenure_years)')} AS sqrt_tenure FROM features"""),
    "job_seniority": on("features", """
        SELECT title_std, CASE WHEN contains(title_std, 'chief') THEN 5
                 WHEN contains(title_std, 'director') THEN 4 WHEN contains(title_std, 'manager') THEN 3
                 WHEN contains(title_std, 'senior') THEN 2 ELSE 1 END AS job_seniority,
               count(*) AS records
        FROM features GROUP BY ALL"""),
    "borough_cola": on("features", f"""
        SELECT work_location_borough, CASE work_location_borough WHEN 'manhattan' THEN 1.15e0
                 WHEN 'brooklyn' THEN 1.05e0 WHEN 'queens' THEN 0.95e0 WHEN 'bronx' THEN 0.90e0
                 WHEN 'staten island' THEN 0.88e0 END AS borough_cola, count(*) AS records
        FROM features GROUP BY ALL"""),
    "agency_prestige": on("features", f"""
        SELECT agency_std, {r('mean_salary')} AS mean_salary,
               {r('(rank() OVER (ORDER BY mean_salary) + (count(*) OVER (PARTITION BY mean_salary)'
                  ' - 1) / 2e0) / count(*) OVER ()')} AS agency_prestige
        FROM (SELECT agency_std, avg(base_salary) AS mean_salary FROM features
              GROUP BY agency_std)"""),
    "split_columns": on("features", """
        SELECT fiscal_year, agency_std, title_std, base_salary FROM features WHERE split IN ('train', 'valid')"""),
    "varying_features": on("training", "SELECT column_name, records FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS records, var_pop({c}) AS variance "
        f"FROM training WHERE split = 'train'" for c in (
            "fiscal_year", "tenure_years", "title_frequency", "agency_size",
            "median_salary_by_title", "median_salary_by_agency", "count_of_job_titles",
            "current_year")) + ") WHERE variance > 0.01"),
    "variance_report": on("training", "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {r(f'var_pop({c})')} AS variance, var_pop({c}) > 0.01 AS kept "
        f"FROM training WHERE split = 'train'" for c in (
            "fiscal_year", "tenure_years", "title_frequency", "agency_size",
            "median_salary_by_title", "median_salary_by_agency", "count_of_job_titles",
            "current_year")) + ")"),
})


# Preprocessing: entries of the vector and standardised numbers of the training records.
_HOT = ["agency_std", "title_std", "title_category", "title_std_grouped", "tenure_bucket"]
_Z = ["fiscal_year", "tenure_years", "title_frequency", "agency_size", "median_salary_by_title",
      "median_salary_by_agency", "count_of_job_titles", "current_year"]
_FILLED = ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM t)) AS {c}"
                    for c in _Z)
_MEANS = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN var_pop({c}) > 1e-12 THEN stddev_pop({c}) "
                   f"ELSE 1 END AS s_{c}" for c in _Z)
_ENTRIES = " + ".join(f"(SELECT count(DISTINCT {c}) FROM t)" for c in _HOT)
_SET = " + ".join(f"CASE WHEN abs({c} - m_{c}) > 1e-9 THEN 1 ELSE 0 END" for c in _Z)
QUERIES["preprocess_features"] = on("training", f"""
WITH t AS MATERIALIZED (SELECT * FROM training WHERE split = 'train'),
f AS MATERIALIZED (SELECT agency_std, title_std, base_salary, {_FILLED} FROM t),
m AS MATERIALIZED (SELECT {_MEANS} FROM f)
SELECT CAST(fiscal_year AS INT) AS fiscal_year, agency_std, title_std, base_salary,
       CAST({len(_HOT)} + {_SET} AS INT) AS entries_set,
       CAST({_ENTRIES} + {len(_Z)} AS INT) AS entries,
       {', '.join(f"{r(f'({c} - m_{c}) / s_{c}')} AS {c}__z" for c in _Z)}
FROM f, m""")
