"""Times the headline queries and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from bench_wide import wide_times
from counterloom.plans.catalog import QUERIES

HEADLINE = [
    "counter_stats",
    "resample_mean_5m",
    "find_cut",
    "filter_to_cut",
    "pooled_stats",
    "unpivot_wide",
    "coerce_numeric",
    "scan_counter_lines",
    "read_counter_files",
    "run_status",
    "report_long",
    "report",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("counterloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "32m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    times = {}
    for name in HEADLINE:
        query = QUERIES[name]
        query(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = min(seconds(lambda: query(spark, folder)) for _ in range(2))
    # Beside the sum: other data, and the only figure with a published counterpart.
    wide = wide_times(spark)
    print(
        json.dumps(
            {
                "metric": "headline queries, best of two warm runs",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "wide_logs": wide,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
