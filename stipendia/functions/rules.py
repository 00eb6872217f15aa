"""Ordered keyword rules compiled to one CASE expression each.

A rule is (test, words, label): `has` fires when the text holds any of the words, `is`
when the text equals one of them. The first rule that fires wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipendia.functions.scalars import squeeze, title_case

# Agency keywords, in order.
AGENCY_RULES = [
    ("has", ["education", "educ", "ed ", "pedagogical", "para"], "Department of Education"),
    ("has", ["police"], "Police Department"),
    ("has", ["fire"], "Fire Department"),
    ("has", ["sanitation"], "Department of Sanitation"),
    ("has", ["correction"], "Department of Correction"),
    ("has", ["transportation"], "Department of Transportation"),
    ("has", ["health"], "Department of Health"),
    ("has", ["parks"], "Department of Parks & Recreation"),
    ("has", ["environmental"], "Department of Environmental Protection"),
    ("has", ["homeless"], "Department of Homeless Services"),
    ("has", ["children"], "Administration for Children's Services"),
    ("has", ["aging"], "Department for the Aging"),
    ("has", ["finance"], "Department of Finance"),
    ("has", ["buildings"], "Department of Buildings"),
]

# Broad title categories, in order.
CATEGORY_RULES = [
    ("has", ["police", "nypd"], "Police"),
    ("has", ["fire", "fdny"], "Fire Department"),
    ("has", ["sanitation"], "Sanitation"),
    ("has", ["correction"], "Corrections"),
    ("has", ["teacher", "principal", "pedagogical"], "Education - Teaching"),
    ("has", ["para", "aide", "school secretary"], "Education - Support"),
    ("has", ["nurse", "doctor", "physician", "medical", "emt"], "Medical/Health"),
    ("has", ["administrative", "admin", "clerk", "secretary", "coordinator"], "Administrative"),
    ("has", ["manager", "director", "supervisor", "chief"], "Management"),
    ("has", ["engineer", "technician", "analyst", "specialist"], "Technical"),
]

# Standard titles, in order.
TITLE_RULES = [
    ("has", ["annual ed para"], "Para-Professional"),
    ("has", ["teacher special education"], "Special Education Teacher"),
    ("is", ["teacher"], "Teacher"),
    ("has", ["assistant principal"], "Assistant Principal"),
    ("is", ["principal"], "Principal"),
    ("has", ["guidance counselor"], "Guidance Counselor"),
    ("has", ["school secretary"], "School Secretary"),
    ("has", ["school safety agent"], "School Safety Agent"),
    ("has", ["school social worker"], "School Social Worker"),
    ("has", ["school psycholgist"], "School Psychologist"),
    ("has", ["educational administrator"], "Educational Administrator"),
    ("has", ["p.o. da det gr3"], "Police Detective Grade 3"),
    ("has", ["p.o. det spec"], "Police Detective Specialist"),
    ("is", ["sergeant-"], "Police Sergeant"),
    ("is", ["police officer"], "Police Officer"),
    ("has", ["police officer d/a detective"], "Police Detective"),
    ("has", ["lieutenant"], "Police Lieutenant"),
    ("has", ["captain"], "Police Captain"),
    ("has", ["police communications technician"], "Police Communications Technician"),
    ("has", ["police administrative aide"], "Police Administrative Aide"),
    ("all", ["emergency medical specialist", "paramedic"],
     "Emergency Medical Specialist - Paramedic"),
    ("has", ["emergency medical specialist"], "Emergency Medical Specialist"),
    ("is", ["correction officer"], "Correction Officer"),
    ("is", ["sanitation worker"], "Sanitation Worker"),
    ("is", ["firefighter"], "Firefighter"),
    ("is", ["child protective specialist"], "Child Protective Specialist"),
    ("is", ["community associate"], "Community Associate"),
    ("is", ["community coordinator"], "Community Coordinator"),
    ("is", ["eligibility specialist"], "Eligibility Specialist"),
    ("is", ["job opportunity specialist"], "Job Opportunity Specialist"),
    ("is", ["caseworker"], "Caseworker"),
    ("is", ["community assistant"], "Community Assistant"),
    ("is", ["caretaker"], "Maintenance Worker"),
    ("is", ["clerical associate"], "Clerical Associate"),
    ("is", ["administrative staff analyst"], "Administrative Analyst"),
    ("has", ["principal administrative associate"], "Administrative Associate"),
    ("is", ["traffic enforcement agent"], "Traffic Enforcement Agent"),
    ("is", ["assistant district attorney"], "Assistant District Attorney"),
    ("is", ["occupational therapist"], "Occupational Therapist"),
    ("is", ["computer specialist"], "IT Specialist"),
    ("is", ["computer systems manager"], "IT Systems Manager"),
    ("is", ["agency attorney"], "Attorney"),
    ("is", ["computer associate"], "IT Associate"),
    ("is", ["city research scientist"], "Research Scientist"),
    ("has", ["adm manager"], "Administrative Manager"),
    ("is", ["supervisor"], "Supervisor"),
    ("has", ["senior police administrative aide"], "Senior Police Administrative Aide"),
]

# Accepted borough spellings, matched exactly.
BOROUGHS = {
    "BRONX": "BRONX",
    "BROOKLYN": "BROOKLYN",
    "MANHATTAN": "MANHATTAN",
    "QUEENS": "QUEENS",
    "RICHMOND": "STATEN ISLAND",
    "Bronx": "BRONX",
    "Manhattan": "MANHATTAN",
    "Queens": "QUEENS",
    "Richmond": "STATEN ISLAND",
}

# Seniority by title keyword, and cost factors by borough.
SENIORITY = {"chief": 5, "director": 4, "manager": 3, "senior": 2, "junior": 1, "assistant": 1}
BOROUGH_COST = {
    "MANHATTAN": 1.15, "BROOKLYN": 1.05, "QUEENS": 0.95, "BRONX": 0.90, "STATEN ISLAND": 0.88,
}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _fires(column: str, test: str, words: list[str]) -> str:
    if test == "is":
        return f"{column} in ({', '.join(map(_quoted, words))})"
    hits = [f"contains({column}, {_quoted(w)})" for w in words]
    return (" and " if test == "all" else " or ").join(hits)


def first_match(column: str, rules, otherwise: str) -> Column:
    """The label of the first rule that fires on a column of lower-case text.

    Takes a column name, not an expression: the text is then computed once per row and not
    once per rule.
    """
    branches = [f"when {_fires(column, t, words)} then {_quoted(label)}"
                for t, words, label in rules]
    return F.expr(f"case {' '.join(branches)} else {otherwise} end")


def with_standard_names(df: DataFrame) -> DataFrame:
    """Add agency_std, title_category and title_std."""
    agency, title = F.col("agency_name"), F.col("title_description")
    blank = F.lit(" \t\n\r\f\u000b")
    return (
        df.withColumns({"_agency": F.trim(agency, blank), "_title": F.trim(title, blank)})
        .withColumns({"_agency_low": F.lower("_agency"), "_title_low": F.lower("_title")})
        .withColumns({
            "agency_std": F.when(agency.isNull(), "Unknown Agency").otherwise(F.coalesce(
                first_match("_agency_low", AGENCY_RULES, "null"), title_case(F.col("_agency")))),
            "title_category": F.when(title.isNull(), "Unknown Role").otherwise(
                first_match("_title_low", CATEGORY_RULES, "'Other Roles'")),
            "title_std": F.when(title.isNull(), "Unknown").otherwise(F.coalesce(
                first_match("_title_low", TITLE_RULES, "null"), F.initcap(squeeze(title)))),
        })
        .drop("_agency", "_title", "_agency_low", "_title_low")
    )


def lookup(c: Column, table: dict) -> Column:
    """Map values exactly; anything else is null."""
    chain = F
    for key, value in table.items():
        chain = chain.when(c == key, F.lit(value))
    return chain


def official_borough(c: Column) -> Column:
    return lookup(c, BOROUGHS)


def job_seniority(title: Column) -> Column:
    text = F.lower(title)
    scores = [F.when(text.contains(w), F.lit(s)) for w, s in SENIORITY.items()]
    return F.coalesce(F.greatest(*scores), F.lit(1))
