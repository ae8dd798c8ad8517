"""Readings of chosen counters straight from logs, without a store."""

from collections.abc import Iterator
from functools import reduce
from itertools import islice
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterloom.schema import COUNTERS, SAMPLES, TICK
from counterloom.shared import settle
from counterloom.sources.counter_logs import (
    ROUND_FILES,
    counter_dictionary,
    known_headers,
    layouts,
    list_logs,
    read_samples,
)


class Extraction(NamedTuple):
    """Readings, their counters, and the files whose header could not be read."""

    samples: DataFrame
    counters: DataFrame
    failures: DataFrame


def _rounds(layout: DataFrame, size: int) -> Iterator[list[str]]:
    names = (row.run_id for row in layout.select("run_id").toLocalIterator())
    while batch := list(islice(names, size)):
        yield batch


def extract_rounds(
    spark: SparkSession,
    root: str,
    patterns: list[str],
    headers: DataFrame | None = None,
    time_column: str | None = None,
    round_files: int = ROUND_FILES,
) -> Extraction:
    """Readings of the matching counters of all logs under ``root``.

    Headers are read once and settled as layouts. A file without a matching counter
    or time column is not opened again. The others are scanned in rounds, each
    straight into the result: nothing is binned, cut or written, and the scan runs
    when the samples are used. Settle them to use them more than once.
    """
    own = settle(known_headers(list_logs(spark, root), headers), "headers")
    found = layouts(own.filter("error is null"), patterns, time_column)
    layout = settle(found.filter("time_pos is not null and size(wanted) > 0"), "layouts")
    scans = [
        read_samples(spark, names, layout.filter(F.col("run_id").isin(names)))
        for names in _rounds(layout, round_files)
    ]
    samples = reduce(DataFrame.unionByName, scans) if scans else spark.createDataFrame([], SAMPLES)
    counters = counter_dictionary(layout) if scans else spark.createDataFrame([], COUNTERS)
    failures = own.filter("error is not null").select("run_id", "size_bytes", "error")
    return Extraction(samples.filter(F.col("pos") != TICK), counters, failures)
