"""Times the whole job on wide logs, with headers that agree and headers that differ.

Each log has 6,500 counters, 120 of them wanted. In one folder all logs have them at
the same positions, in the other each log has its own; BENCH_WIDE_FILES and
BENCH_WIDE_ROWS set their size. A third folder has the published workload's three
logs, 35,806 rows, with positions of their own.
"""

import datetime as dt
import json
import os
import random
import time

from pyspark.sql import SparkSession

from counterloom.plans.report import log_statistics, report_cells, store_statistics
from counterloom.schema import DEFAULT_BASELINE, DEFAULT_PATTERNS
from counterloom.shared import new_folder, settled_scope
from counterloom.sources.store import ingest_new

FILES = int(os.environ.get("BENCH_WIDE_FILES", "24"))
ROWS = int(os.environ.get("BENCH_WIDE_ROWS", "300"))
PUBLISHED_ROWS = [16_130, 10_806, 8_870]
COLUMNS = int(os.environ.get("BENCH_COLUMNS", "6500"))
WANTED = 119


def write_log(path: str, server: str, rows: int, seed: int, own_places: bool) -> None:
    rng = random.Random(seed)
    wanted = [DEFAULT_BASELINE] + [
        f"Object {i}(instance)\\{DEFAULT_PATTERNS[i % len(DEFAULT_PATTERNS)]}" for i in range(WANTED)
    ]
    places = random.Random(seed if own_places else 0).sample(range(COLUMNS), len(wanted))
    names = [f"Process(worker#{i})\\Handle Total" for i in range(COLUMNS)]
    for place, name in zip(sorted(places), wanted):
        names[place] = name
    header = ["(PDH-CSV 4.0) (GMT Standard Time)(0)", *(f"\\\\{server}\\{name}" for name in names)]
    cells = [f'"{rng.choice([0, 0, 0, 1, 17, 4096, round(rng.random(), 4)])}"' for _ in range(COLUMNS)]
    start = dt.datetime(2025, 2, 5, 10, 31, 14) + dt.timedelta(days=seed)
    with open(path, "w", buffering=1 << 20) as out:
        out.write(",".join(f'"{c}"' for c in header) + "\r\n")
        for i in range(rows):
            ts = (start + dt.timedelta(seconds=i)).strftime("%m/%d/%Y %H:%M:%S.") + f"{i % 1000:03d}"
            load = rng.uniform(80, 120) if i < rows * 0.8 else rng.uniform(1, 3)
            for place in places:
                cells[place] = f'"{rng.uniform(0, 1000):.6f}"'
            cells[min(places)] = f'"{load:.6f}"'
            out.write(f'"{ts}",{",".join(cells)}\r\n')


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 2)


def write_logs(spark: SparkSession, rows: list[int], own_places: bool) -> tuple[str, float]:
    """A folder of logs with the given numbers of rows, and its gigabytes."""
    root = new_folder(spark, "wide-logs").removeprefix("file:")
    os.makedirs(root)
    for seed, count in enumerate(rows):
        write_log(f"{root}/run{seed}.csv", f"SRV{seed}", count, seed, own_places)
    return root, round(sum(os.path.getsize(f"{root}/{f}") for f in os.listdir(root)) / 1e9, 3)


def wide_times(spark: SparkSession) -> dict[str, float]:
    """Seconds of the whole job by case, best of two for the small folders."""

    def report(root: str) -> None:
        report_cells(log_statistics(spark, root)).collect()

    times = {}
    with settled_scope(spark):
        for case, own in (("same_places", False), ("own_places", True)):
            root, times["gigabytes"] = write_logs(spark, [ROWS] * FILES, own)
            times[case] = min(timed(lambda: report(root)) for _ in range(2))  # noqa: B023
        store = new_folder(spark, "wide-store")
        times["ingest"] = timed(
            lambda: ingest_new(spark, root, store, DEFAULT_PATTERNS, DEFAULT_BASELINE)
        )
        times["from_store"] = timed(
            lambda: report_cells(store_statistics(spark, store)).collect()
        )
        root, times["published_size_gigabytes"] = write_logs(spark, PUBLISHED_ROWS, True)
        times["published_size"] = timed(lambda: report(root))
    return times


if __name__ == "__main__":
    from bench import session

    found = wide_times(session(os.environ.get("BENCH_CPUS", "8")))
    print(json.dumps({"metric": "wide logs", "queries": found}))
