from __future__ import annotations

from oracle.base import TABLES, buckets, on, pct, r
from oracle.profile import histogram

LABELS = ["0-1 years", "2-3 years", "4-5 years", "6-10 years", "11-20 years", "20+ years"]
CAPPED = "CASE WHEN employee_agency_tenure IS NOT NULL THEN least(employee_agency_tenure, 35e0) END"

TABLES["tenured"] = ("population", f"""
SELECT *, {buckets('tenure_capped', [None, 1, 3, 5, 10, 20, None], LABELS, right=False)}
         AS tenure_bucket_simple
FROM (SELECT *, {CAPPED} AS tenure_capped FROM population)""")

TABLES["ml_tenured"] = ("tenured", f"""
SELECT *, tenure_capped AS tenure_years_raw, ln(1 + tenure_capped) AS tenure_log,
       tenure_capped * tenure_capped AS tenure_squared,
       {buckets('tenure_capped', [None, 0, 3, 7, 15, None], ['0', '1-3', '4-7', '8-15', '15+'])}
         AS tenure_bucket_ml,
       CAST(coalesce(tenure_capped >= 10, false) AS INT) AS is_senior,
       CAST(coalesce(tenure_capped >= 4 AND tenure_capped < 10, false) AS INT) AS is_mid_career,
       CAST(coalesce(tenure_capped < 4, false) AS INT) AS is_early_career,
       CASE WHEN agency_start_date IS NOT NULL THEN greatest(0e0,
         date_diff('day', agency_start_date, DATE '2015-01-01') / 365.25e0) END AS years_since_2015
FROM tenured""")

QUALITY = f"""
SELECT {r('min(employee_agency_tenure)')} AS min_years,
       {r('max(employee_agency_tenure)')} AS max_years,
       {r('avg(employee_agency_tenure)')} AS mean_years,
       {r('stddev_samp(employee_agency_tenure)')} AS std_years,
       count(*) - count(employee_agency_tenure) AS missing,
       count(*) FILTER (WHERE employee_agency_tenure < 0) AS negative,
       count(*) FILTER (WHERE employee_agency_tenure = 0) AS zero,
       count(*) FILTER (WHERE employee_agency_tenure > 50) AS over_50,
       count(*) FILTER (WHERE employee_agency_tenure > 35) AS capped,
       CAST(min(agency_start_date) AS STRING) AS first_start,
       CAST(max(agency_start_date) AS STRING) AS last_start,
       count(*) - count(agency_start_date) AS missing_start,
       {r('quantile_cont(employee_agency_tenure, 0.5)')} AS median_years
FROM population
"""

VALIDATION = f"""
SELECT {r('corr(employee_agency_tenure, calculated)')} AS correlation,
       {r('avg(calculated)')} AS mean_calculated_tenure
FROM (SELECT employee_agency_tenure,
             date_diff('day', agency_start_date,
                       make_date((SELECT max(fiscal_year) FROM population), 12, 31)) / 365.25e0
               AS calculated FROM population)
"""

PROGRESSION = f"""
SELECT tenure_bucket_simple, bucket_order, {r('mean_salary')} AS mean_salary,
       {r('change')} AS change, {r('change_pct')} AS change_pct,
       {r('sum(change_pct) OVER (ORDER BY bucket_order)')} AS cumulative_pct
FROM (SELECT *, mean_salary - previous AS change,
             100e0 * (mean_salary - previous) / previous AS change_pct
      FROM (SELECT *, lag(mean_salary) OVER (ORDER BY bucket_order) AS previous
            FROM (SELECT tenure_bucket_simple,
                         list_position({LABELS}, tenure_bucket_simple) - 1 AS bucket_order,
                         avg(base_salary) AS mean_salary
                  FROM tenured WHERE tenure_bucket_simple IS NOT NULL GROUP BY ALL)))
WHERE previous IS NOT NULL
"""


def _stage(a: str, b: str) -> str:
    return f"avg(base_salary) FILTER (WHERE tenure_bucket_simple IN ('{a}', '{b}'))"


EARLY, MID, SENIOR = (_stage(*LABELS[i:i + 2]) for i in (0, 2, 4))

CORRELATIONS = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {r(f'corr({f}, ln(greatest(base_salary, 1)))')} AS log_base_salary, "
    f"{r(f'corr({f}, base_salary)')} AS base_salary FROM ml_tenured"
    for f in ("tenure_years_raw", "tenure_log", "tenure_squared", "years_since_2015"))

AGENCIES = f"""
SELECT agency_name, round(avg(tenure_capped), 1) AS mean_tenure, count(tenure_capped) AS employees,
       {r('quantile_cont(tenure_capped, 0.5)')} AS median_tenure
FROM tenured WHERE agency_name IS NOT NULL GROUP BY agency_name"""


def _extremes(least: int) -> str:
    return f"""
SELECT * FROM (SELECT *, 'highest' AS extreme FROM ({AGENCIES}) WHERE employees >= {least}
               ORDER BY mean_tenure DESC, agency_name LIMIT 10)
UNION ALL
SELECT * FROM (SELECT *, 'lowest' AS extreme FROM ({AGENCIES}) WHERE employees >= {least}
               ORDER BY mean_tenure, agency_name LIMIT 10)"""


GROUP = buckets("tenure_capped", [0, 5, 10, 20, 35],
                ["Early (0-5)", "Mid (5-10)", "Senior (10-20)", "Veteran (20+)"])

HEATMAP = f"""
SELECT tenure_group, title_category, round(avg(base_salary), 0) AS avg_salary
FROM (SELECT *, {GROUP} AS tenure_group FROM tenured)
WHERE tenure_group IS NOT NULL AND title_category IN (
  SELECT title_category FROM tenured GROUP BY title_category
  ORDER BY count(*) DESC, title_category LIMIT 8)
GROUP BY tenure_group, title_category
"""

MASTER = f"""
SELECT coalesce(agency_name, 'Unknown') AS agency_name,
       coalesce(title_description, 'Unknown') AS title_description,
       title_category, title_std, agency_std, {r('employee_agency_tenure')} AS employee_agency_tenure,
       {r('coalesce(tenure_capped, 0)')} AS tenure_capped,
       coalesce(tenure_bucket_simple, '0-1 years') AS tenure_bucket_simple,
       coalesce(tenure_bucket_ml, '0') AS tenure_bucket_ml, is_senior, is_mid_career,
       is_early_career, coalesce(base_salary, 0) AS base_salary,
       coalesce(total_ot_paid, 0) AS total_ot_paid, total_compensation, fiscal_year,
       coalesce(employment_type, 'Unknown') AS employment_type, hours_tracked,
       {r('base_salary / 1000')} AS salary_k,
       CAST(trunc(coalesce(tenure_capped, 0)) AS INT) AS tenure_years,
       base_salary + total_ot_paid AS total_pay,
       total_compensation - base_salary - total_ot_paid AS other_pay
FROM ml_tenured
"""

QUERIES = {
    "tenure_quality": on("population", QUALITY),
    "tenure_validation": on("population", VALIDATION),
    "tenure_buckets": on("tenured", f"""
        SELECT tenure_bucket_simple, count(*) AS records,
               {pct('count(*)', '(SELECT count(*) FROM tenured)')} AS pct
        FROM tenured WHERE tenure_bucket_simple IS NOT NULL GROUP BY 1"""),
    "new_hires": on("tenured", f"""
        SELECT count(*) AS new_hires, {r('avg(base_salary)')} AS avg_salary
        FROM tenured WHERE tenure_capped < 0.5"""),
    "new_hire_agencies": on("tenured", """
        SELECT agency_name, count(*) AS new_hires FROM tenured
        WHERE tenure_capped < 0.5 AND agency_name IS NOT NULL
        GROUP BY 1 ORDER BY new_hires DESC, agency_name LIMIT 5"""),
    "salary_by_tenure": on("tenured", f"""
        SELECT tenure_bucket_simple, {r('avg(base_salary)')} AS mean,
               {r('stddev_samp(base_salary)')} AS std, count(base_salary) AS count,
               {r('quantile_cont(base_salary, 0.5)')} AS median
        FROM tenured WHERE tenure_bucket_simple IS NOT NULL GROUP BY 1"""),
    "tenure_progression": on("tenured", PROGRESSION),
    "career_stage": on("tenured", f"""
        SELECT {r(EARLY)} AS early_career, {r(MID)} AS mid_career, {r(SENIOR)} AS senior_career,
               {pct(f'{MID} - {EARLY}', EARLY)} AS mid_uplift_pct,
               {pct(f'{SENIOR} - {EARLY}', EARLY)} AS senior_uplift_pct FROM tenured"""),
    "pay_by_tenure": on("tenured", f"""
        SELECT tenure_bucket_simple, {r('avg(total_ot_paid)')} AS avg_ot,
               {r('avg(total_other_pay)')} AS avg_other,
               {r('avg(total_ot_paid) + avg(total_other_pay)')} AS avg_combined
        FROM tenured WHERE tenure_bucket_simple IS NOT NULL GROUP BY 1"""),
    "tenure_linear_fit": on("tenured", f"""
        SELECT {r('regr_slope(base_salary, tenure_capped)')} AS slope,
               {r('regr_intercept(base_salary, tenure_capped)')} AS intercept,
               {r('regr_r2(base_salary, tenure_capped)')} AS r2
        FROM tenured WHERE tenure_capped <= 35"""),
    "tenure_correlations": on("ml_tenured", CORRELATIONS),
    "tenure_agency_extremes": on("tenured", _extremes(100)),
    "tenure_agency_chart": on("tenured", _extremes(500)),
    "tenure_by_category": on("tenured", f"""
        SELECT title_category, {r('avg(tenure_capped)')} AS mean_tenure,
               count(tenure_capped) AS employees,
               {r('quantile_cont(tenure_capped, 0.5)')} AS median_tenure
        FROM tenured GROUP BY title_category"""),
    "senior_share": on("tenured", f"""
        SELECT {pct('count(*) FILTER (WHERE tenure_capped > 10)', 'count(*)')} AS pct_over_10_years
        FROM tenured"""),
    "salary_band_by_tenure": on("tenured", f"""
        SELECT tenure_bucket_simple, {r('avg(base_salary)')} AS mean_salary,
               {r('quantile_cont(base_salary, 0.025)')} AS lower,
               {r('quantile_cont(base_salary, 0.975)')} AS upper
        FROM tenured WHERE tenure_bucket_simple IS NOT NULL GROUP BY 1"""),
    "tenure_category_heatmap": on("tenured", HEATMAP),
    "tenure_master": on("ml_tenured", MASTER),
    "tenure_histogram": on("tenured", histogram(
        "SELECT 'tenure_capped' AS column_name, tenure_capped AS value FROM tenured", "50")),
    "tenure_percentiles": on("tenured", "SELECT " + ", ".join(
        f"{r(f'quantile_cont(tenure_capped, {p / 100})')} AS p{p}" for p in (25, 50, 75, 90))
        + " FROM tenured"),
}
