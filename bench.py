"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

QUERIES = ["ts1_daily_returns", "ts2_daily_returns_padded", "ts7_risk_return", "ts13_history_metrics", "ts15_asof_price", "sc5_composite_score", "sc9_target_quality", "ps1_panel_stats", "ps4_random_weight_search", "ps6_evolutionary_search", "pf5_absolute_risk", "pf7_window_performance", "lg6_allocate_fees", "lg10_positions", "lg12_holdings_totals", "lg14_real_daily", "lg15_monthly_twr_from_trades", "rb4_best_candidate", "rb9_rebalance_gate", "hc5_calibration_summary"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from quantjobs.plans import registry

    queries, times = registry.queries(), {}
    queries[QUERIES[0]](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    for name in QUERIES:
        began = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total wall-clock of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
