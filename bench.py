"""Headline queries in bulk at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = ("recurring_cashpoints", "account_features", "chain_timing", "collapsed_edges", "velocity_by_case", "case_detections",
             "nearest_machines", "machine_cells", "case_forecasts", "forward_surface", "alerts", "replay_hits", "custody_chain", "money_trail", "components", "trace_all_complaints", "stream_complaint_intake")


def main() -> None:
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    from cashtrail.plans import catalogue
    from cashtrail.plans.place_queries import Picture
    from cashtrail.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    queries = catalogue.queries()
    spark.read.parquet(f"{folder}/nation.parquet").count()  # JVM and reader warm-up
    seconds, rows = {}, {}
    for name in sys.argv[1:] or HEADLINES:
        # every query builds its own tables: nothing is carried over from the one before
        Picture.forget()
        began = time.perf_counter()
        seen = Observation()
        # every column of every row is produced, nothing is pruned away by a count
        queries[name](spark, folder).observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        rows[name] = seen.get["rows"]
        seconds[name] = round(time.perf_counter() - began, 2)
    rate = {"cases_per_second": round(rows["case_forecasts"] / seconds["case_forecasts"], 1)} if "case_forecasts" in rows else {}
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 2), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/")), "rows": rows, **rate}))


if __name__ == "__main__":
    main()
