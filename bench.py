"""Headline queries timed on local Spark; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_ONLY (comma-separated names).
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from fieldorder.plans import load_queries
from fieldorder.sources.tables import Tables

HEADLINE = [
    "D01_form_last_5_10", "D02_form_ewm", "D05_venue_history", "D12_overtaking_index", "E01_championship_position",
    "E04_car_pace_delta", "E09_contest_spearman", "C08_range_join", "C11_quote_as_of", "C14_traffic", "F06_run_pace",
    "G01_elo", "G02_elo_contest_step", "H01_win_probability", "H03_place_probabilities", "H08_fit_temperature",
    "H16_calibration_error", "H22_paired_bootstrap", "H30_walk_forward", "A15_flatten_races", "J02_source_timeline",
    "J11_settlement", "K02_weighted_score",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    todo = load_queries()
    Tables(spark, folder).results.write.format("noop").mode("overwrite").save()  # start the JVM's engines
    times = {}
    for name in only or HEADLINE:
        t0 = time.time()
        todo[name].build(Tables(spark, folder)).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({
        "metric": "headline queries, total wall clock", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
