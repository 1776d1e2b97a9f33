"""Headline queries, timed: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from glidepath.session import session
from glidepath.workbench import QUERIES

HEADLINE = [
    "g01_point_features", "g05_tracks", "g06_segments", "g14_incremental_tracks", "g15_holding", "g17_touchdowns", "g21_irregularities",
    "g22_live_flags", "g27_causal_windows", "a01_congestion", "a03_kpis", "a06_field_coverage", "a11_band_report", "f02_demand_series",
    "f08_backtest", "f14_bucket_mase", "h01_psi", "h08_step_timings", "j05_prediction_errors", "j11_asof", "m02_arrival_training_set",
    "m13_gate", "p01_silver", "r01_two_hop_stream", "s15_predictions", "t03_cosine_topk", "t04_harvest", "t05_grounding", "v10_headline",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"})
    QUERIES["f01_bin_counts"](spark, sf_dir).count()  # start the executors
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))[2:]}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
