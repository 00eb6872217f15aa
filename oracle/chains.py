"""Rule chains as plain SQL, typed out on their own: nothing comes from the engine.

{t} stands for the text in lower case. The first test that holds wins.
"""

from __future__ import annotations

# Official boroughs by accepted spelling.
BOROUGH = """CASE {t}
  WHEN 'BRONX' THEN 'BRONX' WHEN 'BROOKLYN' THEN 'BROOKLYN' WHEN 'MANHATTAN' THEN 'MANHATTAN'
  WHEN 'QUEENS' THEN 'QUEENS' WHEN 'RICHMOND' THEN 'STATEN ISLAND' WHEN 'Bronx' THEN 'BRONX'
  WHEN 'Manhattan' THEN 'MANHATTAN' WHEN 'Queens' THEN 'QUEENS' WHEN 'Richmond' THEN 'STATEN ISLAND'
END"""
BOROUGHS = ["BRONX", "BROOKLYN", "MANHATTAN", "QUEENS", "STATEN ISLAND"]

# Standard agencies.
AGENCY = """CASE
  WHEN {t} LIKE '%education%' OR {t} LIKE '%educ%' OR {t} LIKE '%ed %' OR {t} LIKE '%pedagogical%'
       OR {t} LIKE '%para%' THEN 'Department of Education'
  WHEN {t} LIKE '%police%' THEN 'Police Department'
  WHEN {t} LIKE '%fire%' THEN 'Fire Department'
  WHEN {t} LIKE '%sanitation%' THEN 'Department of Sanitation'
  WHEN {t} LIKE '%correction%' THEN 'Department of Correction'
  WHEN {t} LIKE '%transportation%' THEN 'Department of Transportation'
  WHEN {t} LIKE '%health%' THEN 'Department of Health'
  WHEN {t} LIKE '%parks%' THEN 'Department of Parks & Recreation'
  WHEN {t} LIKE '%environmental%' THEN 'Department of Environmental Protection'
  WHEN {t} LIKE '%homeless%' THEN 'Department of Homeless Services'
  WHEN {t} LIKE '%children%' THEN 'Administration for Children''s Services'
  WHEN {t} LIKE '%aging%' THEN 'Department for the Aging'
  WHEN {t} LIKE '%finance%' THEN 'Department of Finance'
  WHEN {t} LIKE '%buildings%' THEN 'Department of Buildings'
  ELSE {other} END"""

# Title categories.
CATEGORY = """CASE
  WHEN regexp_matches({t}, 'police|nypd') THEN 'Police'
  WHEN regexp_matches({t}, 'fire|fdny') THEN 'Fire Department'
  WHEN regexp_matches({t}, 'sanitation') THEN 'Sanitation'
  WHEN regexp_matches({t}, 'correction') THEN 'Corrections'
  WHEN regexp_matches({t}, 'teacher|principal|pedagogical') THEN 'Education - Teaching'
  WHEN regexp_matches({t}, 'para|aide|school secretary') THEN 'Education - Support'
  WHEN regexp_matches({t}, 'nurse|doctor|physician|medical|emt') THEN 'Medical/Health'
  WHEN regexp_matches({t}, 'administrative|admin|clerk|secretary|coordinator') THEN 'Administrative'
  WHEN regexp_matches({t}, 'manager|director|supervisor|chief') THEN 'Management'
  WHEN regexp_matches({t}, 'engineer|technician|analyst|specialist') THEN 'Technical'
  ELSE 'Other Roles' END"""

# Standard titles.
TITLE = """CASE
  WHEN {t} LIKE '%annual ed para%' THEN 'Para-Professional'
  WHEN {t} LIKE '%teacher special education%' THEN 'Special Education Teacher'
  WHEN {t} = 'teacher' THEN 'Teacher'
  WHEN {t} LIKE '%assistant principal%' THEN 'Assistant Principal'
  WHEN {t} = 'principal' THEN 'Principal'
  WHEN {t} LIKE '%guidance counselor%' THEN 'Guidance Counselor'
  WHEN {t} LIKE '%school secretary%' THEN 'School Secretary'
  WHEN {t} LIKE '%school safety agent%' THEN 'School Safety Agent'
  WHEN {t} LIKE '%school social worker%' THEN 'School Social Worker'
  WHEN {t} LIKE '%school psycholgist%' THEN 'School Psychologist'
  WHEN {t} LIKE '%educational administrator%' THEN 'Educational Administrator'
  WHEN {t} LIKE '%p.o. da det gr3%' THEN 'Police Detective Grade 3'
  WHEN {t} LIKE '%p.o. det spec%' THEN 'Police Detective Specialist'
  WHEN {t} = 'sergeant-' THEN 'Police Sergeant'
  WHEN {t} = 'police officer' THEN 'Police Officer'
  WHEN {t} LIKE '%police officer d/a detective%' THEN 'Police Detective'
  WHEN {t} LIKE '%lieutenant%' THEN 'Police Lieutenant'
  WHEN {t} LIKE '%captain%' THEN 'Police Captain'
  WHEN {t} LIKE '%police communications technician%' THEN 'Police Communications Technician'
  WHEN {t} LIKE '%police administrative aide%' THEN 'Police Administrative Aide'
  WHEN {t} LIKE '%emergency medical specialist%' AND {t} LIKE '%paramedic%'
    THEN 'Emergency Medical Specialist - Paramedic'
  WHEN {t} LIKE '%emergency medical specialist%' THEN 'Emergency Medical Specialist'
  WHEN {t} = 'correction officer' THEN 'Correction Officer'
  WHEN {t} = 'sanitation worker' THEN 'Sanitation Worker'
  WHEN {t} = 'firefighter' THEN 'Firefighter'
  WHEN {t} = 'child protective specialist' THEN 'Child Protective Specialist'
  WHEN {t} = 'community associate' THEN 'Community Associate'
  WHEN {t} = 'community coordinator' THEN 'Community Coordinator'
  WHEN {t} = 'eligibility specialist' THEN 'Eligibility Specialist'
  WHEN {t} = 'job opportunity specialist' THEN 'Job Opportunity Specialist'
  WHEN {t} = 'caseworker' THEN 'Caseworker'
  WHEN {t} = 'community assistant' THEN 'Community Assistant'
  WHEN {t} = 'caretaker' THEN 'Maintenance Worker'
  WHEN {t} = 'clerical associate' THEN 'Clerical Associate'
  WHEN {t} = 'administrative staff analyst' THEN 'Administrative Analyst'
  WHEN {t} LIKE '%principal administrative associate%' THEN 'Administrative Associate'
  WHEN {t} = 'traffic enforcement agent' THEN 'Traffic Enforcement Agent'
  WHEN {t} = 'assistant district attorney' THEN 'Assistant District Attorney'
  WHEN {t} = 'occupational therapist' THEN 'Occupational Therapist'
  WHEN {t} = 'computer specialist' THEN 'IT Specialist'
  WHEN {t} = 'computer systems manager' THEN 'IT Systems Manager'
  WHEN {t} = 'agency attorney' THEN 'Attorney'
  WHEN {t} = 'computer associate' THEN 'IT Associate'
  WHEN {t} = 'city research scientist' THEN 'Research Scientist'
  WHEN {t} LIKE '%adm manager%' THEN 'Administrative Manager'
  WHEN {t} = 'supervisor' THEN 'Supervisor'
  WHEN {t} LIKE '%senior police administrative aide%' THEN 'Senior Police Administrative Aide'
  ELSE {other} END"""

# Columns of the raw records, of pay, and of numbers; examples of titles.
RAW_COLUMNS = [
    "fiscal_year", "payroll_number", "agency_name", "last_name", "first_name", "mid_init",
    "agency_start_date", "work_location_borough", "title_description",
    "leave_status_as_of_june_30", "base_salary", "pay_basis", "regular_hours",
    "regular_gross_paid", "ot_hours", "total_ot_paid", "total_other_pay",
]
PAY = ["base_salary", "regular_gross_paid", "total_ot_paid", "total_other_pay"]
NUMBERS = ["fiscal_year", "payroll_number", "base_salary", "regular_hours", "regular_gross_paid",
           "ot_hours", "total_ot_paid", "total_other_pay", "employee_agency_tenure"]
TITLE_EXAMPLES = {
    "Annual Ed Para": "Para-Professional",
    "Teacher Special Education": "Special Education Teacher",
    "P.O. Da Det Gr3": "Police Detective Grade 3",
    "Sergeant-": "Police Sergeant",
    "Emergency Medical Specialist-Emt": "Emergency Medical Specialist",
    "Caretaker": "Maintenance Worker",
}
