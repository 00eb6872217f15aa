"""Pay anomaly rules, scores and investigation tables. Input: the analysis population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipendia.functions.scalars import count_where, money, percent, ratio, true
from stipendia.operators.lookup import attach
from stipendia.operators.ranks import MONEY_STEP, summarize
from stipendia.schema import EMPLOYEE_ORDER

# Weight of each rule, and priority by score.
WEIGHTS = {
    "anomaly_ot_gt_base": 3, "anomaly_salary_outlier": 2, "anomaly_high_other_pay": 2,
    "anomaly_new_hired_high_pay": 1,
}
PRIORITIES = [
    (5, "CRITICAL - Multiple severe anomalies"),
    (4, "HIGH - Two+ anomaly types"),
    (3, "MEDIUM - Single severe anomaly"),
]
MIN_TITLE_ROWS = 10


def title_thresholds(population: DataFrame) -> DataFrame:
    """99 % and 90 % salary quantiles of titles with more than ten records."""
    salary = F.col("base_salary")
    stats = summarize(population, ["title_std"], [F.count("*").alias("_rows")],
                      (salary, {"p99": 0.99, "title_salary_p90": 0.9}, MONEY_STEP))
    return stats.where(F.col("_rows") > MIN_TITLE_ROWS).drop("_rows")


def with_rules(population: DataFrame) -> DataFrame:
    """The four rules as columns; a rule with a missing input does not fire."""
    base, other = F.col("base_salary"), F.col("total_other_pay")
    share = F.col("other_pay_pct")
    scored = attach(population, title_thresholds(population), ["title_std"])
    return scored.withColumn("other_pay_pct", ratio(other, base) * 100).withColumns({
        "anomaly_ot_gt_base": true(F.col("total_ot_paid") > base),
        "anomaly_salary_outlier": true(base > F.col("p99")),
        "high_other_pay_loose": true((share > 20) & (other > 5_000)),
        "anomaly_high_other_pay": true((share > 50) & (other > 20_000)),
        "anomaly_new_hired_high_pay": true(
            (base > F.col("title_salary_p90")) & (F.col("employee_agency_tenure") < 1)),
    })


def priority(score: Column) -> Column:
    chain = F
    for least, label in PRIORITIES:
        chain = chain.when(score >= least, F.lit(label))
    return chain.otherwise("LOW")


def with_scores(population: DataFrame) -> DataFrame:
    score = sum((F.col(rule).cast("int") * w for rule, w in WEIGHTS.items()), F.lit(0))
    scored = with_rules(population).withColumn("anomaly_score", score)
    return scored.withColumns({
        "is_anomaly": F.col("anomaly_score") >= 3,
        "investigation_priority": priority(F.col("anomaly_score")),
    })


def anomaly_rule_counts(population: DataFrame) -> DataFrame:
    """Hits and share of all records per rule, the loose form of rule three included."""
    rules = [*WEIGHTS, "high_other_pay_loose"]
    row = with_rules(population).agg(*[
        F.struct(F.lit(r).alias("rule"), count_where(F.col(r)).alias("hits"),
                 percent(count_where(F.col(r)), F.count("*")).alias("pct")).alias(r)
        for r in rules
    ])
    return row.select(F.explode(F.array(*rules)).alias("r")).select("r.*")


def _shares(population: DataFrame, column: str) -> DataFrame:
    total = F.sum("records").over(Window.partitionBy(F.lit(0)))
    return (
        with_scores(population).groupBy(column).agg(F.count("*").alias("records"))
        .withColumn("pct", percent(F.col("records"), total))
    )


def anomaly_scores(population: DataFrame) -> DataFrame:
    return _shares(population, "anomaly_score").withColumn(
        "is_anomaly", F.col("anomaly_score") >= 3)


def anomaly_priorities(population: DataFrame) -> DataFrame:
    return _shares(population, "investigation_priority")


def priority_anomalies(population: DataFrame, top: int = 10) -> DataFrame:
    columns = ["title_std", "base_salary", "total_ot_paid", "total_other_pay",
               "employee_agency_tenure", "agency_std", "anomaly_score", "first_name"]
    return (
        with_scores(population).where(F.col("anomaly_score") >= 4)
        .orderBy(F.desc("anomaly_score"), *EMPLOYEE_ORDER).limit(top).select(*columns)
    )


_TABLE = [
    "agency_std", "title_std", "base_salary", "total_ot_paid", "total_other_pay",
    "total_compensation", "employee_agency_tenure", *WEIGHTS, "anomaly_score",
    "investigation_priority",
]


def investigation_table(population: DataFrame) -> DataFrame:
    """All anomalies, most severe and best paid first."""
    found = with_scores(population).where("is_anomaly")
    return found.orderBy(F.desc("anomaly_score"), F.desc("total_compensation")).select(*_TABLE)


def with_notes(scored: DataFrame) -> DataFrame:
    """One text per anomaly, a part for each rule that fired, and the number of parts."""
    def part(rule: str, *pieces) -> Column:
        texts = [p if isinstance(p, Column) else F.lit(p) for p in pieces]
        return F.when(F.col(rule), F.concat(*texts))

    ot, base, other = F.col("total_ot_paid"), F.col("base_salary"), F.col("total_other_pay")

    def whole(c: Column) -> Column:
        return F.bround(c, 0).cast("long").cast("string")

    months = whole(F.col("employee_agency_tenure") * 12)
    parts = [
        part("anomaly_ot_gt_base", "OT (", money(ot), ") > Base (", money(base), ")"),
        part("anomaly_salary_outlier", "Salary in top 1% for ", F.col("title_std")),
        part("anomaly_high_other_pay", "Other Pay (", money(other), ") is ",
             whole(F.col("other_pay_pct")), "% of base"),
        part("anomaly_new_hired_high_pay", "New hire (", months,
             " months) with pay >90% of peers"),
    ]
    noted = scored.withColumn("investigation_note", F.concat_ws(" | ", *parts))
    return noted.withColumn("note_count", F.regexp_count("investigation_note", F.lit(r"\|")) + 1)


def investigation_notes(population: DataFrame) -> DataFrame:
    found = with_notes(with_scores(population).where("is_anomaly"))
    return found.select(*_TABLE, "other_pay_pct", "investigation_note", "note_count")


def final_investigation(population: DataFrame) -> DataFrame:
    """The published layout, with names."""
    found = with_notes(with_scores(population).where("is_anomaly"))
    return found.select(
        "agency_std", "title_std", "last_name", "first_name", "base_salary", "total_ot_paid",
        "total_other_pay", "total_compensation", "employee_agency_tenure", "anomaly_score",
        "investigation_priority", "investigation_note",
    ).orderBy(F.desc("anomaly_score"))


def note_counts(population: DataFrame) -> DataFrame:
    found = with_notes(with_scores(population).where("is_anomaly"))
    return found.groupBy("note_count").agg(F.count("*").alias("records"))


def agency_anomaly_rate(population: DataFrame, top: int = 10) -> DataFrame:
    """Share of anomalies per agency; an agency without any has no rate and comes last."""
    hits = F.nullif(F.col("anomalies"), F.lit(0))
    return (
        with_scores(population).groupBy("agency_std")
        .agg(count_where(F.col("is_anomaly")).alias("anomalies"), F.count("*").alias("records"))
        .withColumn("anomaly_pct", percent(hits, F.col("records")))
        .orderBy(F.desc_nulls_last("anomaly_pct"), "agency_std").limit(top)
    )
