"""Times the headline queries and prints one JSON line: the sum of their medians, in seconds."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tracewell import plans

QUERIES = ("tier_classification", "fingerprint_deviation", "phase_islands", "topk_retrieval", "knn_confidence")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, times = plans.queries(), {}
    for name in QUERIES:
        runs = []
        for _ in range(4):  # the first one compiles and isn't counted
            began = time.perf_counter()
            known[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "median wall time of five queries, summed", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
