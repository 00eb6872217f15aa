from __future__ import annotations

from oracle.base import TABLES, on, pct, r

TABLES["scored"] = ("population", """
SELECT *, score AS anomaly_score, score >= 3 AS is_anomaly,
       CASE WHEN score >= 5 THEN 'CRITICAL - Multiple severe anomalies'
            WHEN score >= 4 THEN 'HIGH - Two+ anomaly types'
            WHEN score >= 3 THEN 'MEDIUM - Single severe anomaly' ELSE 'LOW' END
         AS investigation_priority
FROM (SELECT *, CAST(anomaly_ot_gt_base AS INT) * 3 + CAST(anomaly_salary_outlier AS INT) * 2
             + CAST(anomaly_high_other_pay AS INT) * 2
             + CAST(anomaly_new_hired_high_pay AS INT) AS score
      FROM (SELECT p.*, 100e0 * (total_other_pay / nullif(base_salary, 0)) AS other_pay_pct,
                   coalesce(total_ot_paid > base_salary, false) AS anomaly_ot_gt_base,
                   coalesce(base_salary > p99, false) AS anomaly_salary_outlier,
                   coalesce(other_pay_pct > 20 AND total_other_pay > 5000, false)
                     AS high_other_pay_loose,
                   coalesce(other_pay_pct > 50 AND total_other_pay > 20000, false)
                     AS anomaly_high_other_pay,
                   coalesce(base_salary > p90 AND employee_agency_tenure < 1, false)
                     AS anomaly_new_hired_high_pay
            FROM population p LEFT JOIN (
              SELECT title_std, quantile_cont(base_salary, 0.99) AS p99,
                     quantile_cont(base_salary, 0.9) AS p90
              FROM population GROUP BY title_std HAVING count(*) > 10) t USING (title_std)))""")

RULES = ["anomaly_ot_gt_base", "anomaly_salary_outlier", "anomaly_high_other_pay",
         "anomaly_new_hired_high_pay", "high_other_pay_loose"]


def _shares(column: str, extra: str = "") -> str:
    return f"""
SELECT {column}, count(*) AS records, {pct('count(*)', '(SELECT count(*) FROM scored)')} AS pct {extra}
FROM scored GROUP BY {column}"""


def _whole(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS STRING)"


def _money(x: str) -> str:
    return f"'$' || format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))"


TABLES["noted"] = ("scored", f"""
SELECT *, concat_ws(' | ',
    CASE WHEN anomaly_ot_gt_base THEN 'OT (' || {_money('total_ot_paid')} || ') > Base ('
         || {_money('base_salary')} || ')' END,
    CASE WHEN anomaly_salary_outlier THEN 'Salary in top 1% for ' || title_std END,
    CASE WHEN anomaly_high_other_pay THEN 'Other Pay (' || {_money('total_other_pay')} || ') is '
         || {_whole('other_pay_pct')} || '% of base' END,
    CASE WHEN anomaly_new_hired_high_pay THEN 'New hire ('
         || {_whole('employee_agency_tenure * 12')} || ' months) with pay >90% of peers' END)
    AS investigation_note,
  1 + len(investigation_note) - len(replace(investigation_note, '|', '')) AS note_count
FROM scored WHERE is_anomaly""")

TABLE = f"""agency_std, title_std, base_salary, total_ot_paid, total_other_pay, total_compensation,
    {r('employee_agency_tenure')} AS employee_agency_tenure, anomaly_ot_gt_base,
    anomaly_salary_outlier, anomaly_high_other_pay, anomaly_new_hired_high_pay, anomaly_score,
    investigation_priority"""

QUERIES = {
    "anomaly_rule_counts": on("scored", "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{x}' AS rule, count(*) FILTER (WHERE {x}) AS hits, "
        f"{pct(f'count(*) FILTER (WHERE {x})', 'count(*)')} AS pct FROM scored" for x in RULES)
        + ")"),
    "anomaly_scores": on("scored", _shares("anomaly_score", ", anomaly_score >= 3 AS is_anomaly")),
    "anomaly_priorities": on("scored", _shares("investigation_priority")),
    "priority_anomalies": on("scored", f"""
        SELECT title_std, base_salary, total_ot_paid, total_other_pay,
               {r('employee_agency_tenure')} AS employee_agency_tenure, agency_std, anomaly_score,
               first_name
        FROM scored WHERE anomaly_score >= 4
        ORDER BY anomaly_score DESC, first_name, last_name, fiscal_year, base_salary,
                 total_ot_paid, total_other_pay LIMIT 10"""),
    "investigation_table": on("scored", f"SELECT {TABLE} FROM scored WHERE is_anomaly"),
    "investigation_notes": on("noted", f"""
        SELECT {TABLE}, {r('other_pay_pct')} AS other_pay_pct, investigation_note, note_count
        FROM noted"""),
    "investigation_final": on("noted", f"""
        SELECT agency_std, title_std, last_name, first_name, base_salary, total_ot_paid,
               total_other_pay, total_compensation,
               {r('employee_agency_tenure')} AS employee_agency_tenure, anomaly_score,
               investigation_priority, investigation_note FROM noted"""),
    "investigation_note_counts": on("noted", """
        SELECT note_count, count(*) AS records FROM noted GROUP BY note_count"""),
    "agency_anomaly_rate": on("scored", f"""
        SELECT agency_std, count(*) FILTER (WHERE is_anomaly) AS anomalies, count(*) AS records,
               {pct('nullif(count(*) FILTER (WHERE is_anomaly), 0)', 'count(*)')} AS anomaly_pct
        FROM scored GROUP BY agency_std ORDER BY anomaly_pct DESC NULLS LAST, agency_std LIMIT 10"""),
}
