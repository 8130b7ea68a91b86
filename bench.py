"""Headline timings. Prints one JSON line.

Input: $BENCH_SF_DIR (default /root/testdata/sf0.1), local[$BENCH_CPUS]. The chain positions -> features -> labels ->
predictions is timed as it is built and written once; the queries after it read those tables, as a deployment would.
"""
from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from scarp.plans import catalogue
from scarp.plans.fixtures import Inputs

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
QUERIES = ["flagship", "precision_at_k", "rank_within_date", "pr_auc", "reliability", "compare_models", "label_stats",
           "feature_coverage_corr", "tier_threshold", "prediction_index", "brief_table", "banks_by_year",
           "position_error", "px_focal_lee", "px_open", "px_otsu", "px_components", "cast_transects",
           "break_lines_on_gaps", "bank_height", "catalog_group_passes", "incremental_pass"]


def timed(run) -> float:
    t = time.perf_counter()
    run()
    return round(time.perf_counter() - t, 3)


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.shuffle.partitions", CPUS)
             # small inputs: let every core take part in the window stages
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    i = Inputs(spark, SF_DIR)
    spark.range(1000).selectExpr("sum(id)").collect()
    out = {"build_positions": timed(i.panel), "build_features": timed(i.features), "build_labels": timed(i.labels),
           "build_predictions": timed(i.predictions)}
    known = {**catalogue.queries(), "flagship": catalogue.flagship}
    for name in QUERIES:
        out[name] = timed(lambda: known[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    sf = SF_DIR.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "chain and query time", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": sf}))


if __name__ == "__main__":
    main()
