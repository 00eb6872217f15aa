from __future__ import annotations

from oracle.base import COMP, buckets, lit, on, pct, r, shown
from oracle.chains import BOROUGH, BOROUGHS, TITLE_EXAMPLES
from oracle.profile import describe

_MAP = BOROUGH.format(t="spelling")

TREND = f"""
SELECT max(n) AS peak, first(fiscal_year ORDER BY n DESC, fiscal_year) AS peak_year,
       min(n) AS low, first(fiscal_year ORDER BY n, fiscal_year) AS low_year,
       {pct('last(n ORDER BY fiscal_year) - first(n ORDER BY fiscal_year)',
            'first(n ORDER BY fiscal_year)')} AS growth_pct,
       {r('avg(n)')} AS average,
       max(n) FILTER (WHERE fiscal_year = 2019) AS employees_2019,
       max(n) FILTER (WHERE fiscal_year = 2020) AS employees_2020,
       abs(employees_2020 - employees_2019) > 10000 AS pandemic_noticeable,
       list(n ORDER BY fiscal_year)[-1] > list(n ORDER BY fiscal_year)[-4] AS recent_growth
FROM (SELECT fiscal_year, count(*) AS n FROM clean GROUP BY fiscal_year)
"""

EFFECT = f"""
SELECT count(DISTINCT agency_name) AS agencies_before, count(DISTINCT agency_std) AS agencies_after,
       count(DISTINCT title_description) AS titles_before, count(DISTINCT title_std) AS titles_after,
       count(DISTINCT title_category) AS categories,
       {pct('agencies_before - agencies_after', 'agencies_before')} AS agency_reduction_pct,
       {pct('titles_before - titles_after', 'titles_before')} AS title_reduction_pct
FROM standard
"""

BOROUGHS_SQL = """
SELECT data_set, borough, n AS records,
       round(100e0 * n / sum(n) OVER (PARTITION BY data_set), 2) AS pct
FROM (SELECT data_set, coalesce(work_location_borough, 'UNKNOWN/NaN') AS borough, count(*) AS n
FROM (SELECT 'combined' AS data_set, work_location_borough FROM population
      UNION ALL SELECT CASE WHEN hours_tracked THEN 'hourly' ELSE 'salaried' END,
                       work_location_borough FROM population
      UNION ALL SELECT 'hourly_without_doe', work_location_borough FROM population
      WHERE hours_tracked AND agency_std <> 'Department of Education')
GROUP BY ALL)
"""

VERSUS = f"""
SELECT work_location_borough, salaried_pct, hourly_pct,
       {r('hourly_pct - salaried_pct')} AS difference, abs(hourly_pct - salaried_pct) > 5 AS flagged
FROM (SELECT work_location_borough,
             round(100e0 * count(*) FILTER (WHERE NOT hours_tracked)
                   / (SELECT count(*) FROM population WHERE NOT hours_tracked), 2) AS salaried_pct,
             round(100e0 * count(*) FILTER (WHERE hours_tracked)
                   / (SELECT count(*) FROM population WHERE hours_tracked), 2) AS hourly_pct
      FROM population GROUP BY work_location_borough)
WHERE work_location_borough IS NOT NULL
"""

LOW = f"SELECT *, {COMP} AS total_compensation FROM clean WHERE {COMP} < base_salary * 0.5"
LOW_COLUMNS = ["base_salary", "regular_gross_paid", "total_ot_paid", "total_other_pay",
               "total_compensation", "regular_hours"]
HOURS = buckets("regular_hours", [0, 100, 500, 1000, 2080],
                ["Very Low (<100h)", "Low (100-500h)", "Partial (500-1000h)", "Full Year (1000+h)"])

_SHOWN = ["payroll_number", "agency_start_date", "employee_agency_tenure"]

QUERIES = {
    "borough_clean": on("payroll_raw", f"""
        SELECT spelling, count(*) AS records, {_MAP} AS borough,
               {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct
        FROM (SELECT coalesce(work_location_borough, 'UNKNOWN') AS spelling
              FROM (SELECT DISTINCT * FROM payroll_raw)
              WHERE leave_status_as_of_june_30 = 'ACTIVE') GROUP BY spelling"""),
    "borough_share_2014": on("payroll_raw", f"""
        SELECT work_location_borough AS value, count(*) AS n,
               {pct('count(*)', '(SELECT count(*) FROM payroll_raw WHERE fiscal_year = 2014)')}
                 AS pct
        FROM payroll_raw WHERE fiscal_year = 2014 AND work_location_borough IS NOT NULL
        GROUP BY 1 ORDER BY n DESC, value LIMIT 10"""),
    "borough_year_pivot": on("standard", "SELECT fiscal_year, " + ", ".join(
        f"count(*) FILTER (WHERE work_location_borough = {lit(b)}) AS "
        f"{b.lower().replace(' ', '_')}" for b in BOROUGHS)
        + " FROM standard WHERE pay_basis = 'per Annum' GROUP BY fiscal_year"),
    "workforce_by_year": on("clean", """
        SELECT fiscal_year, count(*) AS employees FROM clean GROUP BY fiscal_year"""),
    "workforce_trend": on("clean", TREND),
    "standardization_effect": on("standard", EFFECT),
    "title_examples": on("standard", "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT {lit(a)} AS original, {lit(b)} AS standard, "
        f"count(*) FILTER (WHERE title_description = {lit(a)}) AS original_records, "
        f"count(*) FILTER (WHERE title_std = {lit(b)}) AS standard_records FROM standard"
        for a, b in TITLE_EXAMPLES.items()) + ")"),
    "title_search": on(
        "standard", shown("standard", *_SHOWN) + " WHERE lower(title_std) = 'president'"),
    "borough_distribution": on("population", BOROUGHS_SQL),
    "borough_hourly_vs_salaried": on("population", VERSUS),
    "low_comp_share": on("clean", f"""
        SELECT count(*) FILTER (WHERE {COMP} < base_salary * 0.5) AS records,
               {pct(f'count(*) FILTER (WHERE {COMP} < base_salary * 0.5)', 'count(*)')} AS pct
        FROM clean"""),
    "low_comp_profile": on("clean", describe(LOW_COLUMNS, f"({LOW})")),
    "hours_buckets": on("clean", f"""
        SELECT hours_bucket, count(*) AS records FROM (SELECT {HOURS} AS hours_bucket FROM ({LOW}))
        WHERE hours_bucket IS NOT NULL GROUP BY hours_bucket"""),
    "salaried_by_agency": on("population", f"""
        SELECT agency_std AS value, count(*) AS n,
               {pct('count(*)', '(SELECT count(*) FROM population WHERE NOT hours_tracked)')} AS pct
        FROM population WHERE NOT hours_tracked GROUP BY 1 ORDER BY n DESC, value LIMIT 20"""),
    "clean_payroll": on("clean", shown("clean", *_SHOWN)),
    "head_sample": on("clean", shown("clean", *_SHOWN) + """
        ORDER BY first_name, last_name, fiscal_year, base_salary, total_ot_paid, total_other_pay
        LIMIT 200"""),
    "meaningful_employment": on("population", shown("population", *_SHOWN)),
}
