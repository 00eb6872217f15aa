"""Times the headline queries and prints one line of JSON.

The stages (cleaning chain, features, reference table, panel) are built from the given tables
and written once, timed as build_*. Queries then start from them, as in a payroll pipeline;
each is timed as the median of three warm runs that fetch the whole result.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from stipendia import session
from stipendia.plans.registry import QUERIES, Tables

STAGES = ["standard", "population", "model", "features", "reference", "panel"]
HEADLINE = [
    "dedup_report", "numeric_profile", "cardinality_profile", "top_values", "workforce_trend",
    "standardization_effect", "segment_profile", "ot_overview", "ot_by_agency", "ot_brackets",
    "top_ot_agency_per_year", "salary_by_tenure", "salary_band_by_tenure",
    "tenure_category_heatmap", "tenure_histogram", "anomaly_scores", "investigation_notes",
    "agency_anomaly_rate", "temporal_split", "yoy_growth", "salary_trajectory",
    "year_relative_salary", "stratified_sample", "regression_metrics",
]
MODELS = ["load_payroll", "reference_features", "train_linear_family", "train_forest", "train_gbt",
          "tune_alpha", "cross_validate", "score_test_year"]


def seconds(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
        "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).groupBy("id").count().count()

    times = {f"build_{s}": seconds(lambda s=s: getattr(Tables(spark, folder), s)) for s in STAGES}
    for name in HEADLINE:
        runs = [seconds(lambda: QUERIES[name](spark, folder).collect()) for _ in range(4)]
        times[name] = median(runs[1:])
    for name in MODELS:
        times[name] = seconds(lambda: QUERIES[name](spark, folder).collect())
    times = {k: round(v, 3) for k, v in times.items()}
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
