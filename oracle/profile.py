from __future__ import annotations

from oracle.base import lit, on, pct, r, shown
from oracle.chains import NUMBERS, PAY, RAW_COLUMNS

OBJECTS = ["agency_name", "last_name", "first_name", "agency_start_date", "work_location_borough",
           "title_description"]


SKETCHED = ["agency_std", "title_std", "title_category", "work_location_borough", "total_compensation"]


def stacked(columns: list[str], table: str, cast: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {lit(c)} AS column_name, CAST({c} AS {cast}) AS value FROM {table}"
        for c in columns)


def describe(columns: list[str], table: str) -> str:
    return f"""
SELECT column_name, count(value) AS count, {r('avg(value)')} AS mean,
       {r('stddev_samp(value)')} AS std, {r('min(value)')} AS min, {r('max(value)')} AS max,
       {r('quantile_cont(value, 0.25)')} AS p25, {r('quantile_cont(value, 0.5)')} AS p50,
       {r('quantile_cont(value, 0.75)')} AS p75
FROM ({stacked(columns, table, 'DOUBLE')}) GROUP BY column_name"""


def histogram(stack: str, bins: str | None) -> str:
    """Equal-width bins per column; `bins` is SQL or None for the automatic number."""
    span = "(hi - lo)"
    sturges = f"{span} / (log2(rows_) + 1e0)"
    by_iqr = "2e0 * (q3 - q1) / pow(rows_, 1e0 / 3e0)"
    width = f"CASE WHEN {by_iqr} > 0 THEN least({by_iqr}, {sturges}) ELSE {sturges} END"
    number = bins or f"greatest(coalesce(ceil({span} / nullif({width}, 0)), 1), 1)"
    return f"""
SELECT column_name, CAST(bin AS BIGINT) AS bin, count(*) AS n,
       {r('any_value(lo) + bin * (any_value(span) / any_value(bins))')} AS bin_low,
       {r('any_value(lo) + (bin + 1) * (any_value(span) / any_value(bins))')} AS bin_high,
       {r('count(*) / nullif(any_value(rows_) * (any_value(span) / any_value(bins)), 0)')}
         AS density
FROM (SELECT *, hi - lo AS span,
             least(coalesce(floor((value - lo) * bins / nullif(hi - lo, 0)), 0), bins - 1) AS bin
      FROM (SELECT v.*, s.lo, s.hi, CAST(s.rows_ AS DOUBLE) AS rows_,
                   CAST({number} AS BIGINT) AS bins
            FROM ({stack}) v JOIN (
              SELECT column_name, min(value) AS lo, max(value) AS hi, count(value) AS rows_,
                     quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
              FROM ({stack}) GROUP BY column_name) s USING (column_name)
            WHERE value IS NOT NULL))
GROUP BY column_name, bin"""


TOP = f"""
SELECT column_name, value, n, place, {pct('n', '(SELECT count(*) FROM clean)')} AS pct FROM (
  SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value ASC NULLS FIRST)
            AS place
  FROM (SELECT column_name, value, count(*) AS n FROM ({stacked(OBJECTS, 'clean', 'STRING')})
        GROUP BY column_name, value))
WHERE place <= 10
"""


def shares(column: str, table: str, top: int | None = None) -> str:
    tail = f"ORDER BY n DESC, value ASC NULLS FIRST LIMIT {top}" if top else ""
    return f"""
SELECT {column} AS value, count(*) AS n, {pct('count(*)', f'(SELECT count(*) FROM {table})')} AS pct
FROM {table} GROUP BY 1 {tail}"""


QUERIES = {
    "load_payroll": on("payroll_raw", shown("payroll_raw", "payroll_number")),
    "rejected_records": on("payroll_raw", """
        SELECT * FROM (
          SELECT 'line' AS column_name, CASE payroll_number % 97 WHEN 1 THEN 'missing fields' ELSE 'extra fields' END
                 AS reason, count(*) AS records
          FROM payroll_raw WHERE payroll_number % 97 IN (1, 2) GROUP BY 2
          UNION ALL SELECT 'base_salary', 'not double', count(*) FROM payroll_raw WHERE payroll_number % 97 = 4
          UNION ALL SELECT 'regular_hours', 'not double', count(*) FROM payroll_raw WHERE payroll_number % 97 = 5
          UNION ALL SELECT 'agency_start_date', 'not a date', count(*) FROM payroll_raw
          WHERE agency_start_date = '99/99/9999' AND coalesce(payroll_number % 97, 0) NOT IN (1, 2))
        WHERE records > 0"""),
    "accepted_records": on("payroll_raw", f"""
        WITH whole AS (
          SELECT * REPLACE (CASE WHEN payroll_number % 97 = 4 THEN NULL ELSE base_salary END AS base_salary,
                            CASE WHEN payroll_number % 97 = 5 THEN NULL ELSE regular_hours END AS regular_hours)
          FROM payroll_raw WHERE coalesce(payroll_number % 97, 0) NOT IN (1, 2))
        {shown("whole", "payroll_number")}"""),
    "incremental_records": on("payroll_raw", f"""
        SELECT CASE WHEN fiscal_year <= 2022 THEN 1 ELSE 2 END AS batch, fiscal_year, count(*) AS records,
               {r("sum(total_ot_paid)")} AS ot_paid
        FROM (SELECT DISTINCT * FROM payroll_raw) GROUP BY 1, 2"""),
    "dedup_report": on("payroll_raw", """
        SELECT a AS rows_before, b AS rows_after, a - b AS removed
        FROM (SELECT (SELECT count(*) FROM payroll_raw) AS a,
                     (SELECT count(*) FROM (SELECT DISTINCT * FROM payroll_raw)) AS b)"""),
    "missing_profile": on("payroll_raw", "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT {lit(c)} AS column_name, count(*) - count({c}) AS missing FROM payroll_raw"
        for c in RAW_COLUMNS) + ")"),
    "numeric_profile": on("clean", describe(NUMBERS, "clean")),
    "quantile_sketches": on("clean", f"""
        SELECT column_name, count(value) AS n, probability, TRUE AS within
        FROM ({stacked(NUMBERS, "(SELECT * FROM clean WHERE fiscal_year BETWEEN 2016 AND 2022)", 'DOUBLE')}),
             (VALUES (0.25e0), (0.5e0), (0.75e0)) asked(probability)
        WHERE value IS NOT NULL GROUP BY column_name, probability"""),
    "distinct_sketches": on("population", f"""
        WITH v AS ({" UNION ALL ".join(
            f"SELECT '{c}' AS column_name, CAST({c} AS STRING) AS value, fiscal_year FROM population"
            for c in SKETCHED)})
        SELECT 'any year' AS years, column_name, count(DISTINCT value) AS exact, TRUE AS near FROM v GROUP BY 2
        UNION ALL SELECT '2021 and 2022', column_name, count(*) FILTER (WHERE years = 2), TRUE
        FROM (SELECT column_name, value, count(DISTINCT fiscal_year) AS years FROM v
              WHERE fiscal_year IN (2021, 2022) AND value IS NOT NULL
              GROUP BY column_name, value) GROUP BY column_name"""),
    "heavy_hitters": on("clean", f"""
        SELECT column_name, value, n FROM (
          SELECT column_name, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY column_name) AS total
          FROM ({stacked(SKETCHED[:4], 'clean', 'STRING')}) WHERE value IS NOT NULL GROUP BY column_name, value)
        WHERE n * 50 > total"""),
    "cardinality_profile": on("payroll_raw", f"""
        SELECT column_name, count(DISTINCT value) AS distinct_values
        FROM ({stacked(RAW_COLUMNS, 'payroll_raw', 'STRING')}) GROUP BY column_name"""),
    "top_values": on("clean", TOP),
    "leave_status_counts": on("payroll_raw", shares("leave_status_as_of_june_30", "payroll_raw")),
    "pay_basis_counts": on("standard", shares("pay_basis", "standard")),
    "top_titles": on("standard", shares("title_std", "standard", 20)),
    "sign_checks": on("located", "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT {lit(c)} AS column_name, count(*) FILTER (WHERE {c} < 0) AS negative, "
        f"count(*) FILTER (WHERE {c} = 0) AS zero FROM located" for c in PAY) + ")"),
    "numeric_histograms": on("clean", histogram(stacked(NUMBERS, "clean", "DOUBLE"), None)),
}
