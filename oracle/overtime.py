from __future__ import annotations

from oracle.base import buckets, on, pct, r

PROFILE = f"""
SELECT segment, count(*) AS records, {r('avg(total_compensation)')} AS avg_comp,
       max(total_compensation) AS max_comp, {r('avg(base_salary)')} AS avg_base,
       {r('avg(total_ot_paid)')} AS avg_ot,
       {pct('sum(total_ot_paid)', 'sum(total_compensation)')} AS ot_pct_comp,
       count(DISTINCT agency_std) AS agencies, min(fiscal_year) AS first_year,
       max(fiscal_year) AS last_year,
       {r('quantile_cont(total_compensation, 0.5)')} AS median_comp
FROM segmented GROUP BY segment
"""

OVERVIEW = f"""
SELECT sum(total_compensation) AS total_payroll, sum(total_ot_paid) AS total_ot,
       {pct('sum(total_ot_paid)', 'sum(total_compensation)')} AS ot_pct_payroll,
       count(*) FILTER (WHERE total_ot_paid > 0) AS workers_with_ot,
       count(*) FILTER (WHERE total_ot_paid = 0) AS workers_no_ot,
       {pct('count(*) FILTER (WHERE total_ot_paid > 0)', 'count(*)')} AS pct_with_ot,
       {pct('count(*) FILTER (WHERE total_ot_paid = 0)', 'count(*)')} AS pct_no_ot,
       {r('avg(total_ot_paid)')} AS avg_ot_all,
       {r('avg(total_ot_paid) FILTER (WHERE total_ot_paid > 0)')} AS avg_ot_workers,
       max(total_ot_paid) AS max_ot,
       {r('quantile_cont(total_ot_paid, 0.5) FILTER (WHERE total_ot_paid > 0)')}
         AS median_ot_workers
FROM hourly
"""

BY_SEGMENT = f"""
SELECT segment, count(*) FILTER (WHERE total_ot_paid > 0) AS workers_with_ot,
       {pct('count(*) FILTER (WHERE total_ot_paid > 0)', 'count(*)')} AS pct_with_ot,
       {r('avg(total_ot_paid) FILTER (WHERE total_ot_paid > 0)')} AS avg_ot_workers,
       {pct('sum(total_ot_paid)', 'sum(total_compensation)')} AS ot_pct_comp,
       max(total_ot_paid) AS max_ot,
       {r('quantile_cont(total_ot_paid, 0.5) FILTER (WHERE total_ot_paid > 0)')}
         AS median_ot_workers
FROM segmented WHERE segment <> 'DOE' GROUP BY segment
"""

BY_AGENCY = f"""
SELECT agency_std, sum(total_ot_paid) AS total_ot, {r('avg(total_ot_paid)')} AS avg_ot,
       count(total_ot_paid) AS workers, count(*) FILTER (WHERE total_ot_paid > 0) AS ot_workers,
       sum(total_compensation) AS total_comp,
       {pct('sum(total_ot_paid)', 'sum(total_compensation)')} AS ot_pct_payroll,
       {pct('count(*) FILTER (WHERE total_ot_paid > 0)', 'count(total_ot_paid)')} AS ot_worker_pct
FROM hourly GROUP BY agency_std ORDER BY total_ot DESC, agency_std LIMIT 15
"""

TREND = f"""
SELECT fiscal_year, sum(total_ot_paid) AS total_ot, {r('avg(total_ot_paid)')} AS avg_ot,
       sum(total_compensation) AS total_comp, count(total_ot_paid) AS headcount,
       {pct('sum(total_ot_paid)', 'sum(total_compensation)')} AS ot_pct
FROM hourly GROUP BY fiscal_year
"""

LABELS = ["No OT", "Low (<$10k)", "Medium ($10-25k)", "High ($25-50k)", "Very High ($50-100k)",
          "Extreme (>$100k)"]

BRACKETS = f"""
SELECT ot_bracket, count(total_ot_paid) AS workers, {r('avg(total_ot_paid)')} AS avg_ot,
       sum(total_ot_paid) AS total_ot,
       {pct('count(total_ot_paid)', '(SELECT count(*) FROM hourly)')} AS worker_pct,
       list_position({LABELS}, ot_bracket) - 1 AS bracket_order
FROM (SELECT *, {buckets('total_ot_paid', [0, 1, 10000, 25000, 50000, 100000, None], LABELS)}
             AS ot_bracket FROM hourly)
WHERE ot_bracket IS NOT NULL GROUP BY ot_bracket
"""

DIVE = f"""
SELECT subject, fiscal_year, count(total_ot_paid) AS headcount, sum(total_ot_paid) AS total_ot,
       {r('avg(total_ot_paid)')} AS avg_ot, {r('avg(total_compensation)')} AS avg_comp,
       count(*) FILTER (WHERE total_ot_paid > 100000) AS extreme_ot,
       {pct('sum(total_ot_paid)', 'sum(total_compensation)')} AS ot_pct_comp
FROM (SELECT 'Board Of Election' AS subject, * FROM segmented
      WHERE agency_std = 'Board Of Election' AND hours_tracked
      UNION ALL SELECT 'Chief Marine Engineer', * FROM segmented
      WHERE title_std = 'Chief Marine Engineer' AND segment = 'Civilian'
      UNION ALL SELECT agency_std, * FROM segmented
      WHERE agency_std IN ('Department of Correction', 'Fire Department'))
GROUP BY subject, fiscal_year
"""

TOP_PER_YEAR = f"""
SELECT fiscal_year, agency_std, workers, avg_ot, total_ot FROM (
  SELECT *, row_number() OVER (PARTITION BY fiscal_year ORDER BY total_ot DESC, agency_std) AS place
  FROM (SELECT fiscal_year, agency_std, count(total_ot_paid) AS workers,
               {r('avg(total_ot_paid)')} AS avg_ot, sum(total_ot_paid) AS total_ot
        FROM hourly WHERE total_ot_paid > 100000 AND fiscal_year BETWEEN 2015 AND 2024
        GROUP BY fiscal_year, agency_std))
WHERE place = 1
"""

_A = "SELECT agency_std, sum(total_ot_paid) AS ot, count(*) AS n FROM hourly WHERE fiscal_year = "
CHANGE = f"""
SELECT agency_std, ot_before, ot_after, headcount_before, headcount_after,
       ot_after - ot_before AS ot_change,
       {pct('ot_after - ot_before', 'ot_before')} AS ot_change_pct,
       headcount_after - headcount_before AS headcount_change
FROM (SELECT coalesce(a.agency_std, b.agency_std) AS agency_std, coalesce(a.ot, 0e0) AS ot_before,
             coalesce(b.ot, 0e0) AS ot_after, coalesce(a.n, 0) AS headcount_before,
             coalesce(b.n, 0) AS headcount_after
      FROM ({_A} 2021 GROUP BY agency_std) a
      FULL JOIN ({_A} 2022 GROUP BY agency_std) b ON a.agency_std = b.agency_std)
"""

HOURS_BREAK = f"""
SELECT {r('avg(ot_hours) FILTER (WHERE fiscal_year < 2023)')} AS avg_ot_hours_before,
       {r('avg(ot_hours) FILTER (WHERE fiscal_year >= 2023)')} AS avg_ot_hours_after,
       count(*) FILTER (WHERE fiscal_year >= 2023) AS reliable_rows
FROM population
"""

_EARNER = ("agency_std, title_std, title_category, base_salary, total_ot_paid, total_compensation, "
           "fiscal_year, first_name, last_name")
_TIES = "first_name, last_name, fiscal_year, base_salary, total_ot_paid, total_other_pay"

QUERIES = {
    "segment_counts": on("segmented", f"""
        SELECT segment, count(*) AS records,
               {pct('count(*)', '(SELECT count(*) FROM population)')} AS pct
        FROM segmented GROUP BY segment"""),
    "segment_profile": on("segmented", PROFILE),
    "ot_overview": on("hourly", OVERVIEW),
    "ot_by_segment": on("segmented", BY_SEGMENT),
    "ot_by_agency": on("hourly", BY_AGENCY),
    "ot_trend": on("hourly", TREND),
    "ot_brackets": on("hourly", BRACKETS),
    "agency_ot_deep_dive": on("segmented", DIVE),
    "top_ot_agency_per_year": on("hourly", TOP_PER_YEAR),
    "ot_change_2021_2022": on("hourly", CHANGE + " ORDER BY ot_change DESC, agency_std LIMIT 12"),
    "headcount_change_2021_2022": on("hourly", f"""
        SELECT agency_std, headcount_before, headcount_after, headcount_change FROM ({CHANGE})
        ORDER BY headcount_change, agency_std LIMIT 10"""),
    "ot_hours_break": on("population", HOURS_BREAK),
    "high_earner_counts": on("population", """
        SELECT count(*) FILTER (WHERE total_compensation > 200000) AS above_200k,
               count(*) FILTER (WHERE total_compensation > 300000) AS above_300k,
               count(*) FILTER (WHERE total_compensation > 500000) AS above_500k
        FROM population"""),
    "top_earners": on("population", f"""
        SELECT {_EARNER} FROM population ORDER BY total_compensation DESC, {_TIES} LIMIT 20"""),
    "top_ot_civilian": on("segmented", f"""
        SELECT {_EARNER} FROM segmented WHERE segment = 'Civilian'
        ORDER BY total_ot_paid DESC, {_TIES} LIMIT 5"""),
}
