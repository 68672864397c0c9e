"""Times the headline queries and prints one line of JSON.

Each query's rows are all made (the no-op sink takes them).  The first pass of
a query warms code and files; the median of three more counts.  Besides, the
time that ``observe`` keeps its caller, and a re-analysis of kept signals.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from driftloom.operators.verdict import verdicts
from driftloom.plans import wider
from driftloom.plans.demo import PROFILE
from driftloom.plans.queries import QUERIES
from driftloom.streaming.observer import LiveObserver

HEADLINES = (
    "drift_prev_bow", "drift_anchor_bow", "drift_dual_dense", "entailment_overlap", "certainty_signal", "certainty_delta", "facts_split", "coverage_omission",
    "aggregate_score", "verdicts", "classification", "attribution", "report_summary", "calibrate_percentile", "ablation_variants", "rule_sweep", "threshold_sweep",
    "first_flag_accuracy", "stratified_sample", "label_distribution", "inject_swap_step", "stream_drift_replay",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINES:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    with LiveObserver(spark, PROFILE.drift_threshold, on_flag=lambda flag: None) as live:
        waits = []
        for i in range(50):
            began = time.perf_counter()
            live.observe({"step_id": i, "text": f"some words of step {i % 7}"})
            waits.append(time.perf_counter() - began)
    kept = wider.wide(spark, sf_dir).cache()
    kept.count()
    warm = []
    for _ in range(3):
        began = time.perf_counter()
        verdicts(kept, PROFILE).write.format("noop").mode("overwrite").save()
        warm.append(time.perf_counter() - began)
    kept.unpersist()
    steps = spark.read.parquet(f"{sf_dir}/conversations.parquet").count()
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf"), "steps": steps, "full_analysis_ms_per_step": round(1000 * took["report_summary"] / max(steps, 1), 4), "observe_blocking_ms": round(1000 * statistics.median(waits), 4), "warm_verdicts_ms_per_step": round(1000 * statistics.median(warm) / max(steps, 1), 4)}))


if __name__ == "__main__":
    main()
