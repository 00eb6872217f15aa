"""Common table expressions shared by the oracle queries."""

from __future__ import annotations

from oracle import chains

RAW = """
WITH b AS (
  SELECT l.*, o.o_custkey, o.o_orderdate,
         CASE CAST(o.o_custkey % 16 AS INT)
           WHEN 0 THEN 'DEPT OF ED PEDAGOGICAL'        WHEN 1 THEN 'DEPT OF ED PEDAGOGICAL'
           WHEN 2 THEN 'DEPT OF ED PARA PROFESSIONALS' WHEN 3 THEN 'POLICE DEPARTMENT'
           WHEN 4 THEN 'POLICE DEPARTMENT'             WHEN 5 THEN 'FIRE DEPARTMENT'
           WHEN 6 THEN 'DEPARTMENT OF CORRECTION'      WHEN 7 THEN 'DEPARTMENT OF SANITATION'
           WHEN 8 THEN 'HRA/DEPT OF SOCIAL SERVICES'   WHEN 9 THEN 'ADMIN FOR CHILDREN SVCS'
           WHEN 10 THEN 'DEPT OF PARKS & RECREATION'   WHEN 11 THEN 'BOARD OF ELECTION'
           WHEN 12 THEN 'DEPT OF HEALTH/MENTAL HYGIENE' WHEN 13 THEN 'NYC HOUSING AUTHORITY'
           WHEN 14 THEN ' department of  finance ' ELSE NULL END AS agency_name,
         CASE CAST(l.l_partkey % 24 AS INT)
           WHEN 0 THEN 'TEACHER' WHEN 1 THEN 'TEACHER' WHEN 2 THEN 'TEACHER SPECIAL EDUCATION'
           WHEN 3 THEN 'ANNUAL ED PARA' WHEN 4 THEN 'POLICE OFFICER' WHEN 5 THEN 'P.O. DA DET GR3'
           WHEN 6 THEN 'SERGEANT-' WHEN 7 THEN 'LIEUTENANT D/A SPECIAL ASSIGNMENT'
           WHEN 8 THEN 'SENIOR POLICE ADMINISTRATIVE AIDE' WHEN 9 THEN 'FIREFIGHTER'
           WHEN 10 THEN 'EMERGENCY MEDICAL SPECIALIST-PARAMEDIC'
           WHEN 11 THEN 'EMERGENCY MEDICAL SPECIALIST-EMT'
           WHEN 12 THEN 'CORRECTION OFFICER' WHEN 13 THEN 'SANITATION WORKER' WHEN 14 THEN 'CARETAKER'
           WHEN 15 THEN 'COMMUNITY ASSOCIATE' WHEN 16 THEN 'COMPUTER SYSTEMS MANAGER'
           WHEN 17 THEN 'CHIEF MARINE  ENGINEER' WHEN 18 THEN 'STAFF NURSE'
           WHEN 19 THEN 'CLERICAL ASSOCIATE'
           WHEN 20 THEN 'CIVIL ENGINEER' WHEN 21 THEN 'ASSISTANT PRINCIPAL' WHEN 22 THEN 'GARDENER'
           ELSE CASE WHEN l.l_partkey % 96 = 23 THEN NULL ELSE 'PRESIDENT' END END AS title_description
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
r AS (
  SELECT CAST(2014 + l_orderkey % 12 AS INT) AS fiscal_year,
         CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE CAST(l_suppkey AS INT) END AS payroll_number,
         agency_name,
         CONCAT('LAST', CAST(l_suppkey AS STRING)) AS last_name,
         CONCAT('FIRST', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-',
                CAST(l_partkey AS STRING)) AS first_name,
         CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE 'M' END AS mid_init,
         CASE WHEN l_partkey % 211 = 3 THEN '99/99/9999' WHEN l_partkey % 211 = 4 THEN NULL
              ELSE CONCAT(LPAD(CAST(MONTH(o_orderdate) AS STRING), 2, '0'), '/',
                     LPAD(CAST(LEAST(DAY(o_orderdate), 28) AS STRING), 2, '0'), '/',
                     CAST(CASE WHEN l_partkey % 97 = 5 THEN 1955
                               ELSE YEAR(o_orderdate) + l_suppkey % 25 END AS STRING)) END
              AS agency_start_date,
         CASE CAST(l_suppkey % 11 AS INT) WHEN 0 THEN 'MANHATTAN' WHEN 1 THEN 'BROOKLYN'
              WHEN 2 THEN 'QUEENS' WHEN 3 THEN 'BRONX' WHEN 4 THEN 'RICHMOND' WHEN 5 THEN 'Bronx'
              WHEN 6 THEN 'Manhattan' WHEN 7 THEN 'Brooklyn' WHEN 8 THEN 'WESTCHESTER'
              WHEN 9 THEN 'MANHATTAN' ELSE NULL END AS work_location_borough,
         title_description,
         CASE WHEN l_linenumber = 7 THEN 'CEASED' WHEN l_partkey % 53 = 0 THEN 'ON LEAVE'
              ELSE 'ACTIVE' END AS leave_status_as_of_june_30,
         CASE WHEN l_partkey % 503 = 1 THEN -1.0 WHEN l_quantity = 1 THEN 5000.0
              WHEN l_partkey % 491 = 2 THEN 600000.0
              ELSE CAST(FLOOR(15000 + l_extendedprice * 1.25) AS DOUBLE) END AS base_salary,
         CASE WHEN l_quantity = 2 THEN 'per Hour' WHEN l_quantity = 3 THEN 'per Day'
              ELSE 'per Annum' END AS pay_basis,
         CASE WHEN agency_name LIKE 'DEPT OF ED%' THEN 0.0 WHEN l_partkey % 509 = 6 THEN -8.0
              ELSE l_quantity * 45.0 END AS regular_hours,
         CAST(FLOOR(14000 + l_extendedprice * 1.2) AS DOUBLE) AS regular_gross_paid,
         CAST(FLOOR(l_discount * 4000 + 0.5) AS DOUBLE) AS ot_hours,
         CAST(FLOOR(CASE WHEN l_partkey % 40 = 0 THEN l_extendedprice * l_discount * 40
                         ELSE l_extendedprice * l_discount * 3 END) AS DOUBLE) AS total_ot_paid,
         CAST(FLOOR(CASE WHEN l_partkey % 37 = 0 THEN l_extendedprice * l_tax * 15
                         ELSE l_extendedprice * l_tax * 2 END) AS DOUBLE) AS total_other_pay,
         l_orderkey
  FROM b)
SELECT fiscal_year, payroll_number, agency_name, last_name, first_name, mid_init, agency_start_date,
       work_location_borough, title_description, leave_status_as_of_june_30,
       CAST(base_salary AS DOUBLE) AS base_salary, pay_basis,
       CAST(regular_hours AS DOUBLE) AS regular_hours, regular_gross_paid, ot_hours, total_ot_paid,
       total_other_pay
FROM (SELECT * FROM r UNION ALL SELECT * FROM r WHERE l_orderkey % 50 = 0) u
"""


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def r(expression: str) -> str:
    """Rounded to four digits, without a negative zero."""
    return f"(round(CAST({expression} AS DOUBLE), 4) + 0e0)"


def pct(a: str, b: str) -> str:
    return r(f"100e0 * ({a}) / nullif(({b}), 0)")


def words(text: str) -> str:
    """First letter of each blank-separated word in upper case, the rest in lower case."""
    return (
        f"array_to_string(list_transform(string_split(lower({text}), ' '), "
        "lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"
    )


def title_case(text: str) -> str:
    marked = f"regexp_replace(lower({text}), '([^a-z ])([a-z])', '\\1' || chr(1) || ' \\2', 'g')"
    return f"replace({words(marked)}, chr(1) || ' ', '')"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def squeeze(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def buckets(x: str, edges: list, labels: list[str], right: bool = True) -> str:
    """Labels of consecutive intervals; None as an edge is an open end."""
    lines = [f"WHEN {x} IS NULL THEN NULL"]
    for low, high, label in zip(edges, edges[1:], labels):
        tests = []
        if low is not None:
            tests.append(f"{x} {'>' if right else '>='} {low}")
        if high is not None:
            tests.append(f"{x} {'<=' if right else '<'} {high}")
        lines.append(f"WHEN {' AND '.join(tests) or 'true'} THEN {lit(label)}")
    return "CASE " + " ".join(lines) + " END"


BOROUGH = chains.BOROUGH.format(t="work_location_borough")

LOCATED = f"""
SELECT * EXCLUDE (work_location_borough, agency_start_date),
       {BOROUGH} AS work_location_borough,
       CASE WHEN d IS NULL THEN NULL
            ELSE greatest(least(d, DATE '2025-10-31'), DATE '1970-01-01') END AS agency_start_date
FROM (SELECT *, CAST(try_strptime(agency_start_date, '%m/%d/%Y') AS DATE) AS d
      FROM (SELECT DISTINCT * FROM payroll_raw))
WHERE leave_status_as_of_june_30 = 'ACTIVE' AND {BOROUGH} IS NOT NULL
"""

STANDARD = f"""
SELECT * EXCLUDE (mid_init, d),
       CASE WHEN agency_start_date IS NOT NULL THEN greatest(0e0,
            date_diff('day', agency_start_date, make_date(fiscal_year, 6, 30)) / 365.25e0) END
            AS employee_agency_tenure,
       CASE WHEN agency_name IS NULL THEN 'Unknown Agency' ELSE
            {chains.AGENCY.format(t=f"lower({strip('agency_name')})",
                                  other=title_case(strip('agency_name')))} END AS agency_std,
       CASE WHEN title_description IS NULL THEN 'Unknown Role' ELSE
            {chains.CATEGORY.format(t="lower(title_description)")} END AS title_category,
       CASE WHEN title_description IS NULL THEN 'Unknown' ELSE
            {chains.TITLE.format(t=f"lower({strip('title_description')})",
                                 other=words(squeeze('title_description')))} END AS title_std
FROM located
WHERE NOT (coalesce(base_salary < 0, false) OR coalesce(regular_gross_paid < 0, false)
           OR coalesce(total_ot_paid < 0, false) OR coalesce(total_other_pay < 0, false))
  AND regular_hours >= 0 AND ot_hours >= 0
"""

CLEAN = """
SELECT * FROM standard
WHERE pay_basis = 'per Annum' AND fiscal_year <> 2014 AND fiscal_year <> 2025
"""

COMP = "coalesce(regular_gross_paid, 0) + coalesce(total_ot_paid, 0) + coalesce(total_other_pay, 0)"

POPULATION = f"""
SELECT * FROM (
  SELECT DISTINCT * EXCLUDE (pay_basis, leave_status_as_of_june_30),
         {COMP} AS total_compensation, coalesce(regular_hours > 0, false) AS hours_tracked,
         {buckets('regular_hours', [None, 100, 500, 1000, None],
                  ['Very_Low_Hours', 'Part_Year', 'Partial_Year', 'Full_Year'])} AS employment_type
  FROM clean)
WHERE total_compensation > 0
  AND ((hours_tracked AND regular_hours >= 1000 AND total_compensation >= 20000)
       OR (NOT hours_tracked AND total_compensation >= 30000))
"""

SEGMENTED = """
SELECT *, CASE WHEN agency_std = 'Department of Education' THEN 'DOE'
               WHEN agency_std IN ('Police Department', 'Fire Department',
                                   'Department of Correction', 'Department of Sanitation')
               THEN 'Uniformed' ELSE 'Civilian' END AS segment
FROM population
"""

HOURLY = "SELECT * FROM population WHERE hours_tracked"

TABLES = {
    "payroll_raw": ("", RAW),
    "located": ("payroll_raw", LOCATED),
    "standard": ("located", STANDARD),
    "clean": ("standard", CLEAN),
    "population": ("clean", POPULATION),
    "segmented": ("population", SEGMENTED),
    "hourly": ("population", HOURLY),
}


GAPPY = ["payroll_number", "agency_title_count", "count_of_job_titles", "current_year"]


def shown(table: str, *columns: str, drop: str = "") -> str:
    """All rows of a table with rounded columns, dates as text, gappy counts as doubles."""
    replaced = []
    for c in columns:
        if c in GAPPY:
            replaced.append(f"CAST({c} AS DOUBLE) AS {c}")
        elif c.endswith("_date"):
            replaced.append(f"CAST({c} AS STRING) AS {c}")
        else:
            replaced.append(f"{r(c)} AS {c}")
    exclude = f"EXCLUDE ({drop})" if drop else ""
    return f"SELECT * {exclude} REPLACE ({', '.join(replaced)}) FROM {table}"


def on(table: str, sql: str) -> str:
    """The query below the chain of tables that `table` is built from."""
    chain = []

    def add(name: str) -> None:
        if name and name not in chain:
            parents, _ = TABLES[name]
            for parent in parents.split():
                add(parent)
            chain.append(name)

    for name in table.split():
        add(name)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({TABLES[n][1]})" for n in chain)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
