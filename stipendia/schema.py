"""Column types and fixed parameters of the payroll tables."""

from __future__ import annotations

# Columns of the raw records with their types, and groups of them.
RAW_TYPES = {
    "fiscal_year": "int",
    "payroll_number": "int",
    "agency_name": "string",
    "last_name": "string",
    "first_name": "string",
    "mid_init": "string",
    "agency_start_date": "string",
    "work_location_borough": "string",
    "title_description": "string",
    "leave_status_as_of_june_30": "string",
    "base_salary": "double",
    "pay_basis": "string",
    "regular_hours": "double",
    "regular_gross_paid": "double",
    "ot_hours": "double",
    "total_ot_paid": "double",
    "total_other_pay": "double",
}

PAY_COLUMNS = ["base_salary", "regular_gross_paid", "total_ot_paid", "total_other_pay"]

NUMERIC_COLUMNS = [
    "fiscal_year", "payroll_number", "base_salary", "regular_hours", "regular_gross_paid",
    "ot_hours", "total_ot_paid", "total_other_pay", "employee_agency_tenure",
]

# Model population bounds and the split by fiscal year.
MIN_BASE_SALARY, MAX_BASE_SALARY = 10_000, 500_000
TRAIN_YEARS, VALID_YEARS, TEST_YEARS = range(2015, 2023), range(2023, 2024), range(2024, 2025)
FIRST_YEAR, LAST_YEAR = 2015, 2024

# Columns of the model population, in order.
POPULATION_COLUMNS = [
    "fiscal_year", "agency_std", "title_std", "title_category", "base_salary",
    "total_compensation", "regular_hours", "work_location_borough", "ot_pay_ratio",
    "ot_hours", "total_ot_paid", "total_other_pay", "employee_agency_tenure",
]

# Model inputs, in order.
CATEGORICAL_FEATURES = [
    "agency_std", "title_std", "title_category", "title_std_grouped", "tenure_bucket", "pay_basis",
]
NUMERIC_FEATURES = [
    "fiscal_year", "tenure_years", "title_frequency", "agency_size", "median_salary_by_title",
    "median_salary_by_agency", "count_of_job_titles", "current_year", "regular_hours",
]

# A unique order of employees for top-k reports.
EMPLOYEE_ORDER = [
    "first_name", "last_name", "fiscal_year", "base_salary", "total_ot_paid", "total_other_pay",
]
