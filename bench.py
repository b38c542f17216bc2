"""Times the headline queries: the thirteen star queries, and a few operators beside them.

Each query runs once to warm up, then ``BENCH_REPEATS`` times; its median counts.
Prints one JSON line; ``value`` is the sum over the star queries.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from millrace.plans import analytics, micro, ssb

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))
BESIDE = ["agg_sum", "agg_count_distinct", "agg_rollup", "join_comma_n_way", "filter_nested", "sort_three", "trace_timeline", "trace_kernel_usage", "scan_prefix_sum", "enc_rle"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = ssb.Tables(spark, SF_DIR)  # opened once, as a catalog would
    star = {f"ssb_{n}": (lambda s, d, n=n: ssb.frame(s, d, n, tables=tables)) for n in ssb.SPECS}
    all_queries = micro.queries() | analytics.queries() | star
    took = {}
    for name in [f"ssb_{n}" for n in ssb.SPECS] + BESIDE:
        times = []
        for _ in range(REPEATS + 1):
            began = time.perf_counter()
            all_queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)
    total = round(sum(v for k, v in took.items() if k.startswith("ssb_")), 4)
    print(json.dumps({"metric": "ssb_13_queries_total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
