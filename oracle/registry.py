"""All oracle queries by name."""

from __future__ import annotations

from oracle import anomaly, benchmark, features, overtime, profile, tenure, workforce
from oracle.base import on

QUERIES: dict[str, str] = {
    **profile.QUERIES, **workforce.QUERIES, **overtime.QUERIES, **tenure.QUERIES,
    **anomaly.QUERIES, **features.QUERIES, **benchmark.QUERIES,
}

# What the sinks hold is what the queries of the same tables return.
_REPORTS = {"anomaly_investigation": "investigation_table",
            "anomaly_investigation_notes": "investigation_notes",
            "anomaly_investigation_final": "investigation_final", "tenure_master": "tenure_master"}
QUERIES["write_reports"] = " UNION ALL ".join(
    f"SELECT '{name}' AS name, count(*) AS records FROM ({QUERIES[query]})"
    for name, query in _REPORTS.items())
QUERIES["write_metadata"] = on("training", """
    SELECT split, count(*) AS records, 'base_salary' AS target, 'log_base_salary' AS log_target,
           'agency_std|title_std|title_category|title_std_grouped|tenure_bucket|fiscal_year|'
           || 'tenure_years|title_frequency|agency_size|median_salary_by_title|'
           || 'median_salary_by_agency|count_of_job_titles|current_year' AS inputs
    FROM training GROUP BY split""")
