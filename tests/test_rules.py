"""Rule chains, buckets and scalar functions on literal rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from stipendia.functions import buckets, rules, scalars


def names(spark, rows):
    df = spark.createDataFrame(rows, "i int, agency_name string, title_description string")
    return rules.with_standard_names(df).orderBy("i").collect()


def test_titles(spark):
    cases = {
        "ANNUAL ED PARA": "Para-Professional", "  teacher ": "Teacher",
        "TEACHER SPECIAL EDUCATION": "Special Education Teacher",
        "PRINCIPAL": "Principal", "ASSISTANT PRINCIPAL IA": "Assistant Principal",
        "PRINCIPAL ADMINISTRATIVE ASSOCIATE": "Administrative Associate",
        "SENIOR POLICE ADMINISTRATIVE AIDE": "Police Administrative Aide",
        "POLICE OFFICER": "Police Officer", "POLICE OFFICER D/A DETECTIVE": "Police Detective",
        "SERGEANT-": "Police Sergeant", "SERGEANT": "Sergeant",
        "EMERGENCY MEDICAL SPECIALIST-PARAMEDIC": "Emergency Medical Specialist - Paramedic",
        "EMERGENCY MEDICAL SPECIALIST-EMT": "Emergency Medical Specialist",
        "CARETAKER": "Maintenance Worker", "CARETAKER (HA)": "Caretaker (ha)",
        "CHIEF MARINE  ENGINEER": "Chief Marine Engineer", "ADM MANAGER-NON-MGRL": "Administrative Manager",
        "SUPERVISOR": "Supervisor", "SUPERVISOR II": "Supervisor Ii", None: "Unknown",
    }
    found = names(spark, [(i, None, t) for i, t in enumerate(cases)])
    assert [r.title_std for r in found] == list(cases.values())


# Typed out, not taken from the rules: a title for every rule, and what becomes of it.
EVERY_TITLE = """
annual ed para=Para-Professional; teacher special education=Special Education Teacher;
teacher=Teacher; assistant principal=Assistant Principal; principal=Principal;
guidance counselor=Guidance Counselor; school secretary=School Secretary;
school safety agent=School Safety Agent; school social worker=School Social Worker;
school psycholgist=School Psychologist; educational administrator=Educational Administrator;
p.o. da det gr3=Police Detective Grade 3; p.o. det spec=Police Detective Specialist;
sergeant-=Police Sergeant; police officer=Police Officer;
police officer d/a detective=Police Detective; lieutenant d/a=Police Lieutenant;
captain=Police Captain; police communications technician=Police Communications Technician;
police administrative aide=Police Administrative Aide;
emergency medical specialist-paramedic=Emergency Medical Specialist - Paramedic;
emergency medical specialist-emt=Emergency Medical Specialist;
correction officer=Correction Officer; sanitation worker=Sanitation Worker;
firefighter=Firefighter; child protective specialist=Child Protective Specialist;
community associate=Community Associate; community coordinator=Community Coordinator;
eligibility specialist=Eligibility Specialist;
job opportunity specialist=Job Opportunity Specialist; caseworker=Caseworker;
community assistant=Community Assistant; caretaker=Maintenance Worker;
clerical associate=Clerical Associate; administrative staff analyst=Administrative Analyst;
principal administrative associate=Administrative Associate;
traffic enforcement agent=Traffic Enforcement Agent;
assistant district attorney=Assistant District Attorney;
occupational therapist=Occupational Therapist; computer specialist=IT Specialist;
computer systems manager=IT Systems Manager; agency attorney=Attorney;
computer associate=IT Associate; city research scientist=Research Scientist;
adm manager=Administrative Manager; supervisor=Supervisor;
senior police administrative aide=Police Administrative Aide"""
EVERY_AGENCY = """
board of education=Department of Education; educ=Department of Education;
dept of ed staff=Department of Education; pedagogical=Department of Education;
para=Department of Education; police=Police Department; fire=Fire Department;
sanitation=Department of Sanitation; correction=Department of Correction;
transportation=Department of Transportation; health=Department of Health;
parks=Department of Parks & Recreation; environmental=Department of Environmental Protection;
homeless=Department of Homeless Services; children=Administration for Children's Services;
aging=Department for the Aging; finance=Department of Finance; buildings=Department of Buildings"""
EVERY_CATEGORY = """
nypd=Police; fdny=Fire Department; sanitation=Sanitation; correction=Corrections;
pedagogical=Education - Teaching; para=Education - Support; aide=Education - Support;
nurse=Medical/Health; doctor=Medical/Health; physician=Medical/Health; medical=Medical/Health;
admin=Administrative; clerk=Administrative; coordinator=Administrative; manager=Management;
director=Management; supervisor=Management; chief=Management; engineer=Technical;
technician=Technical; analyst=Technical; specialist=Technical"""


@pytest.mark.parametrize("text, column, number", [
    (EVERY_TITLE, "title_std", 47), (EVERY_AGENCY, "agency_std", 18),
    (EVERY_CATEGORY, "title_category", 22)])
def test_every_rule_fires(spark, text, column, number):
    pairs = [p.strip().rsplit("=", 1) for p in text.replace("\n", " ").split(";")]
    assert len(pairs) == number
    found = names(spark, [(i, a.upper(), a.upper()) for i, (a, _) in enumerate(pairs)])
    assert [r[column] for r in found] == [label for _, label in pairs]


def test_agencies(spark):
    cases = {
        "DEPT OF ED PEDAGOGICAL": "Department of Education",
        "POLICE DEPARTMENT": "Police Department", " department of  finance ": "Department of Finance",
        "HEALTH AND PARKS": "Department of Health", "FIRE POLICE": "Police Department",
        "ADMIN FOR CHILDREN SVCS": "Administration for Children's Services",
        "  HRA/DEPT OF SOCIAL SERVICES": "Hra/Dept Of Social Services",
        "MAYOR'S OFFICE": "Mayor'S Office", None: "Unknown Agency",
    }
    found = names(spark, [(i, a, None) for i, a in enumerate(cases)])
    assert [r.agency_std for r in found] == list(cases.values())


def test_categories_follow_the_order_of_rules(spark):
    cases = {
        "PARAMEDIC": "Education - Support", "EMT": "Medical/Health", "POLICE AIDE": "Police",
        "SCHOOL SECRETARY": "Education - Support", "SECRETARY": "Administrative",
        "CHIEF ENGINEER": "Management", "GARDENER": "Other Roles", None: "Unknown Role",
    }
    found = names(spark, [(i, None, t) for i, t in enumerate(cases)])
    assert [r.title_category for r in found] == list(cases.values())


def test_boroughs_match_exactly(spark):
    df = spark.createDataFrame([("RICHMOND",), ("Bronx",), ("Brooklyn",), ("STATEN ISLAND",), (None,)],
                               "b string")
    found = [r[0] for r in df.select(rules.official_borough(F.col("b"))).collect()]
    assert found == ["STATEN ISLAND", "BRONX", None, None, None]


VALUES = [-1.0, 0.0, 0.5, 1.0, 1.5, 3.0, 5.0, 10.0, 20.0, 35.0, 40.0, None]


@pytest.mark.parametrize("family, right, expected", [
    (buckets.MODEL_TENURE, True,
     ["0", "0", "1", "1", "2-3", "2-3", "4-5", "6-10", "11-20", "20+", "20+", None]),
    (buckets.REPORT_TENURE, False,
     ["0-1 years"] * 3 + ["2-3 years"] * 2 + ["4-5 years", "6-10 years", "11-20 years"]
     + ["20+ years"] * 3 + [None]),
    (buckets.ML_TENURE, True,
     ["0", "0", "1-3", "1-3", "1-3", "1-3", "4-7", "8-15", "15+", "15+", "15+", None]),
    (buckets.CAREER_TENURE, True,
     [None, None] + ["Early (0-5)"] * 5 + ["Mid (5-10)", "Senior (10-20)", "Veteran (20+)"]
     + [None, None]),
])
def test_bucket_edges(spark, family, right, expected):
    df = spark.createDataFrame([(v,) for v in VALUES], "v double")
    found = [r[0] for r in df.select(buckets.bucket(F.col("v"), family, right)).collect()]
    assert found == expected


def test_dollar_and_hour_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 1e4, 1e5, 100001.0)], "v double")
    found = [r[0] for r in df.select(buckets.bucket(F.col("v"), buckets.OT_DOLLARS)).collect()]
    assert found == [None, "No OT", "Low (<$10k)", "Low (<$10k)", "Very High ($50-100k)",
                     "Extreme (>$100k)"]
    hours = spark.createDataFrame([(v,) for v in (0.0, 100.0, 2080.0, 2081.0)], "v double")
    family = buckets.EMPLOYMENT_HOURS
    low = buckets.bucket(F.col("v"), family, include_lowest=True)
    open_ = buckets.bucket(F.col("v"), buckets.LOW_COMP_HOURS)
    assert [tuple(r) for r in hours.select(low, open_).collect()] == [
        ("Very_Low_Hours", None), ("Very_Low_Hours", "Very Low (<100h)"),
        ("Full_Year", "Full Year (1000+h)"), ("Full_Year", None)]


def test_scalars(spark):
    df = spark.createDataFrame([("1/5/2020",), ("99/99/9999",), ("01/02/1955",), ("12/31/2030",), (None,)],
                               "d string")
    dates = df.withColumn("p", scalars.parsed_date(F.col("d")))
    found = [r[0] for r in dates.select(scalars.plausible_date(F.col("p"))).collect()]
    assert found == [datetime.date(2020, 1, 5), None, datetime.date(1970, 1, 1),
                     datetime.date(2025, 10, 31), None]
    text = spark.createDataFrame([("  A \t b  C ",), (None,)], "t string")
    assert [r[0] for r in text.select(scalars.clean_text(F.col("t"))).collect()] == [
        "a b c", "unknown"]
    number = spark.createDataFrame([("12.5",), ("x",), (None,)], "n string")
    assert [r[0] for r in number.select(scalars.to_double(F.col("n"))).collect()] == [
        12.5, None, None]
    clipped = spark.createDataFrame([(-1.0,), (None,)], "x double").select(
        scalars.clip(F.col("x"), 0.0))
    assert [r[0] for r in clipped.collect()] == [0.0, None]


def test_seniority_and_cost(spark):
    df = spark.createDataFrame([("Assistant Chief",), ("Senior Manager",), ("Clerk",)], "t string")
    assert [r[0] for r in df.select(rules.job_seniority(F.col("t"))).collect()] == [5, 3, 1]
