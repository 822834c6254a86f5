"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).  Every query is run to
its last row through the no-op sink; one untimed run of the first query warms the engine.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["i1_detect_shift", "i1_detect_months", "e1_regularize", "e15_deepest_fall", "i5_isolated_low_points",
            "i7_early_window", "i12_rate_label", "i13_label_table", "i14_person_period_lead1", "i16_renewed_production",
            "i19_modelling_window", "i24_label_sensitivity", "d9_quantiles", "d17_spearman_pooled", "j2_stratified_group_folds",
            "j15_auc_by_day", "j25_bootstrap_counts", "j14_out_of_fold_risk", "j18_panel_fit"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-"))
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from workload import QUERIES

    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run(HEADLINE[0])
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
