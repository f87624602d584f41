"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores (default 8).
Each query is run once to warm up and once measured, from building the plan to the last row.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pingscape.queries import QUERIES  # noqa: E402

HEADLINE = [
    "ag1_device_minute", "tr12_minute_panel", "ge2_point_in_polygon", "jn6_interval_join", "tr18_event_panel",
    "st1_event_ols", "st4_outcome_grid", "tr6_dwell_job", "tr11_home_locations", "ge8_front_distance",
    "tr21_alert_cleaning", "st16_counterfactuals", "bt1_row_bootstrap", "bt4_subsample", "ag17_quantiles",
]


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = session()
    seconds = {}
    for name in names:
        run(spark, name, folder)
        seconds[name] = round(run(spark, name, folder), 3)
    print(json.dumps({
        "metric": "headline queries, total warm time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
