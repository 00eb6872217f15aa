from __future__ import annotations

import oracle.features  # noqa: F401  (its tables come first)
from oracle.base import TABLES, buckets, on, pct, r, shown

TABLES["requests"] = ("features reference panel categories", """
SELECT title_std || ' @ ' || agency_std AS request_id, title_std, agency_std,
       CAST(count(*) % 41 AS INT) AS tenure_years FROM features GROUP BY title_std, agency_std
UNION ALL
SELECT DISTINCT title_std || ' @ nowhere', title_std, 'office of nowhere', 5 FROM features""")

TABLES["inputs"] = ("requests", f"""
SELECT q.request_id, q.title_std, q.agency_std, coalesce(c.title_category, 'other') AS title_category,
       CASE WHEN agency_title_count >= 100 THEN q.title_std ELSE 'other_title' END
         AS title_std_grouped,
       {buckets('tenure_years', [None, 0, 1, 3, 5, 10, 20, None],
                ['0', '1', '2-3', '4-5', '6-10', '11-20', '20+'])} AS tenure_bucket,
       2024 AS fiscal_year, tenure_years,
       (SELECT CAST(sum(agency_title_count) AS BIGINT) FROM reference z
        WHERE z.title_std = q.title_std) AS title_frequency,
       (SELECT CAST(sum(agency_title_count) AS BIGINT) FROM reference z
        WHERE z.agency_std = q.agency_std) AS agency_size,
       agency_title_count, median_salary_by_title, median_salary_by_agency, count_of_job_titles,
       current_year, coalesce(regular_hours, 1820e0) AS regular_hours,
       median_salary_by_title AS title_avg_salary
FROM requests q JOIN reference x ON q.title_std = x.title_std AND q.agency_std = x.agency_std
LEFT JOIN categories c ON q.title_std = c.title_std""")


def _pair(alias: str, age: int) -> str:
    return f"""LEFT JOIN (SELECT * FROM panel
        WHERE fiscal_year = (SELECT max(fiscal_year) FROM panel) - {age}) {alias}
        ON {alias}.title_std = i.title_std AND {alias}.agency_std = i.agency_std"""


def _title(alias: str, age: int) -> str:
    return f"""LEFT JOIN (SELECT title_std, quantile_cont(base_salary, 0.5) AS m FROM panel
        WHERE fiscal_year = (SELECT max(fiscal_year) FROM panel) - {age} GROUP BY title_std) {alias}
        ON {alias}.title_std = i.title_std"""


YOY = f"""
SELECT request_id, i.title_std, i.agency_std, {pct('tn.m - tb.m', 'tb.m')} AS title_growth,
       {pct('n.base_salary - b.base_salary', 'b.base_salary')} AS agency_growth,
       {pct('n.headcount - b.headcount', 'b.headcount')} AS headcount_growth,
       {pct('n.regular_hours - b.regular_hours', 'b.regular_hours')} AS hours_growth
FROM inputs i {_pair('n', 0)} {_pair('b', 1)} {_title('tn', 0)} {_title('tb', 1)}
"""

TABLES["cagr"] = ("panel", """
SELECT title_std, agency_std, count(*) AS points,
       CASE WHEN count(*) >= 2 THEN pow(last(base_salary ORDER BY fiscal_year)
              / first(base_salary ORDER BY fiscal_year),
              1e0 / nullif(max(fiscal_year) - min(fiscal_year), 0)) - 1 ELSE 0.02e0 END AS growth,
       stddev_samp(base_salary) AS deviation
FROM panel GROUP BY title_std, agency_std""")

TRAJECTORY = f"""
SELECT i.request_id, p.fiscal_year, {r('p.base_salary')} AS salary, 'Historical Median' AS kind,
       CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper
FROM inputs i JOIN panel p ON i.title_std = p.title_std AND i.agency_std = p.agency_std
UNION ALL
SELECT request_id, CAST(2024 + k AS INT), {r('salary')}, 'Projected', {r('salary - spread')},
       {r('salary + spread')}
FROM (SELECT request_id, k, now_ * pow(1 + coalesce(growth, 0.02e0), k) AS salary,
             sqrt(k) * CASE WHEN points >= 2 THEN deviation ELSE now_ * 0.1e0 END AS spread
      FROM (SELECT i.request_id, i.median_salary_by_title AS now_, g.*,
                   unnest(range(0, 6)) AS k
            FROM inputs i LEFT JOIN cagr g
              ON i.title_std = g.title_std AND i.agency_std = g.agency_std))
"""

WIDTH = """(SELECT pow(10e0, floor(log10(e))) * CASE WHEN e / pow(10e0, floor(log10(e))) <= 1 THEN 1
       WHEN e / pow(10e0, floor(log10(e))) <= 2 THEN 2 WHEN e / pow(10e0, floor(log10(e))) <= 5 THEN 5
       ELSE 10 END
  FROM (SELECT (max(median_salary_by_title) - min(median_salary_by_title)) / 40 AS e
        FROM reference))"""

TABLES["predicted"] = ("training", """
SELECT *, ln(median_salary_by_title) AS predicted_log_salary FROM training WHERE split = 'test'""")

METRICS = f"""
SELECT count(*) AS rows, {r('1 - avg(e * e) / var_pop(y)')} AS r2, {r('sqrt(avg(e * e))')} AS rmse,
       {r('avg(abs(e))')} AS mae
FROM (SELECT log_base_salary AS y, log_base_salary - predicted_log_salary AS e FROM predicted
      WHERE predicted_log_salary IS NOT NULL)
"""

BEST = f"""
SELECT name, {r('1 - avg(e * e) / var_pop(y)')} AS r2_score
FROM (SELECT 'title_median' AS name, log_base_salary AS y,
             log_base_salary - ln(median_salary_by_title) AS e FROM predicted
      UNION ALL SELECT 'agency_median', log_base_salary,
             log_base_salary - ln(median_salary_by_agency) FROM predicted
      UNION ALL SELECT 'role_median', log_base_salary,
             log_base_salary - ln((median_salary_by_title + median_salary_by_agency) / 2)
      FROM predicted)
WHERE e IS NOT NULL GROUP BY name ORDER BY r2_score DESC, name
"""

_COUNTS = ["agency_title_count", "count_of_job_titles", "current_year"]
KEYS = "fiscal_year, agency_std, title_std, base_salary, total_compensation"

QUERIES = {
    "requests_without_reference": on("requests", """
        SELECT request_id, agency_std, title_std FROM requests q WHERE NOT EXISTS (
          SELECT 1 FROM reference x
          WHERE x.title_std = q.title_std AND x.agency_std = q.agency_std)"""),
    "benchmark_requests": on("inputs", shown("inputs", *_COUNTS)),
    "yoy_growth": on("inputs", YOY),
    "salary_cagr": on("cagr", f"""
        SELECT title_std, agency_std, points, {r('growth')} AS growth, {r('deviation')} AS deviation
        FROM cagr"""),
    "salary_trajectory": on("inputs cagr", TRAJECTORY),
    "median_histogram": on("reference", f"""
        SELECT w * floor(m / w) AS bin_low, w * floor(m / w) + w AS bin_high, count(*) AS roles,
               bool_or(title_std = 'teacher') AS selected
        FROM (SELECT title_std, median_salary_by_title AS m, {WIDTH} AS w FROM reference)
        WHERE m IS NOT NULL GROUP BY 1, 2"""),
    "regression_metrics": on("predicted", METRICS),
    "score_with_errors": on("predicted", f"""
        SELECT {KEYS}, {r('predicted_log_salary')} AS predicted_log_salary,
               {r('exp(predicted_log_salary)')} AS predicted_salary,
               {r('ln(base_salary)')} AS actual_log_salary,
               {r('predicted_log_salary - ln(base_salary)')} AS log_error,
               {pct('exp(predicted_log_salary) - base_salary', 'base_salary')} AS salary_error_pct
        FROM predicted"""),
    "ranked_models": on("predicted", BEST),
    "best_model": on("predicted", BEST + " LIMIT 1"),
    "prediction_interval": on("predicted", f"""
        SELECT {KEYS}, {r('predicted_log_salary')} AS predicted_log_salary,
               {r('predicted_log_salary - half')} AS lower_bound,
               {r('predicted_log_salary + half')} AS upper_bound
        FROM predicted, (SELECT 1.96e0 * stddev_pop(log_base_salary - predicted_log_salary) AS half
                         FROM predicted)"""),
    "error_by_range": on("predicted", f"""
        SELECT CAST(least(greatest(ceil((y - lo) / ((hi - lo) / 10)) - 1, 0), 9) AS BIGINT)
                 AS salary_range, count(*) AS records, {r('avg(e)')} AS mean_error
        FROM (SELECT log_base_salary AS y, log_base_salary - predicted_log_salary AS e,
                     min(log_base_salary) OVER () AS lo, max(log_base_salary) OVER () AS hi
              FROM predicted WHERE predicted_log_salary IS NOT NULL)
        GROUP BY 1"""),
    "blended_prediction": on("predicted", f"""
        SELECT {KEYS}, least(tenure_years, 20) AS tenure_years,
               coalesce(round(0.7e0 * median_salary_by_agency + 0.3e0 * h, 2),
                        round(median_salary_by_agency, 2)) AS expected_salary,
               round(coalesce(h, 0), 2) AS historical_median,
               round(median_salary_by_agency, 2) AS model_prediction_raw
        FROM predicted LEFT JOIN (SELECT title_std, round(avg(base_salary), 0) AS h FROM features
                                  WHERE split = 'train' GROUP BY title_std) USING (title_std)"""),
}
