"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

NAMES = ("cp04_episodes", "cp07_person_day_grid", "cp08_baseline", "cp09_eligibility", "cp11_day_panel", "cp12_events", "cp13_landmark_panel",
         "cp14_risk_sets", "cp15_attrition", "cp17_availability_by_day", "cp26_event_curve", "j03_window_join", "a05_a06_quantiles", "q09_panel_invariants",
         "dc07_complementary", "e03_inverse_weights", "e10_cluster_bootstrap", "e17_standardised", "e19_roc_panel")


def main() -> None:
    from panelwise.plans import registry

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    every, took = registry.queries(), {}
    spark.range(1000).selectExpr("sum(id)").collect()
    for name in NAMES:
        began = time.time()
        every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
