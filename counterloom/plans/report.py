"""Whole jobs: from samples, a directory of logs or a store to the report."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterloom.operators.report import (
    aligned_rows,
    first_by_label,
    label_dictionary,
    label_place,
    labelled_stats,
    pivot_report,
    round_report,
)
from counterloom.operators.select import baseline_counters, describe_counters
from counterloom.operators.series import BIN_MINUTES, find_cut
from counterloom.operators.stats import (
    HEAD,
    add_mbps_rows,
    baseline_bins,
    bin_samples,
    binned_bounds,
    binned_counters,
    kept_stats,
)
from counterloom.schema import DEFAULT_BASELINE, DEFAULT_PATTERNS, OK
from counterloom.shared import new_folder, settle
from counterloom.sources.counter_logs import ROUND_FILES
from counterloom.sources.extraction import extract_rounds
from counterloom.sources.store import ingest_new, open_store


def bin_cuts(
    bins: DataFrame,
    counters: DataFrame,
    baseline: str = DEFAULT_BASELINE,
    minutes: int = BIN_MINUTES,
) -> DataFrame:
    """The cut of each run, its baseline being its first counter that contains ``baseline``."""
    first = baseline_counters(counters, baseline)
    return find_cut(baseline_bins(bins, first), binned_bounds(bins), minutes)


def bin_statistics(
    bins: DataFrame,
    counters: DataFrame,
    baseline: str = DEFAULT_BASELINE,
    keep: str = HEAD,
    minutes: int = BIN_MINUTES,
) -> DataFrame:
    """Labelled average and maximum per run and counter, trimmed at each run's cut.

    One plan; bins are stored, so all its branches read a small table.
    """
    cuts = bin_cuts(bins, counters, baseline, minutes).filter(F.col("status") == OK)
    names = describe_counters(counters.select("run_id", "pos", "counter_path"))
    stats = kept_stats(bins, cuts, keep).join(names, ["run_id", "pos"])
    return labelled_stats(add_mbps_rows(stats), keep)


def run_statistics(
    samples: DataFrame,
    counters: DataFrame | None = None,
    baseline: str = DEFAULT_BASELINE,
    keep: str = HEAD,
    minutes: int = BIN_MINUTES,
) -> DataFrame:
    """``bin_statistics`` of samples, which are read once.

    Samples shrink to bins, the only table that is settled; cuts, trimmed
    statistics and the dictionary of samples that carry their paths come from it.
    """
    bins = settle(bin_samples(samples, minutes), "bins")
    if counters is None:
        counters = binned_counters(bins)
    return bin_statistics(bins, counters, baseline, keep, minutes)


def report_cells(statistics: DataFrame) -> DataFrame:
    """Rounded report cells in long form, complete at any number of runs."""
    return round_report(first_by_label(statistics))


def wide_report(
    statistics: DataFrame, columns: list[str], baseline: str = DEFAULT_BASELINE
) -> DataFrame:
    """The report with the given labels as columns."""
    return pivot_report(report_cells(statistics), baseline, columns)


def found_report(
    statistics: DataFrame, baseline: str = DEFAULT_BASELINE
) -> tuple[DataFrame, DataFrame]:
    """The report with every label of the data as a column: its rows and its columns.

    Rows (``metric, is_baseline, values``) hold their values in the order of the
    columns (``label, column``); ``write_aligned_report`` makes one file of both.
    """
    cells = settle(report_cells(statistics), "cells")
    labels = settle(label_dictionary(cells), "labels")
    return aligned_rows(cells, labels, baseline), labels


def place_report(
    statistics: DataFrame, columns: list[str], baseline: str = DEFAULT_BASELINE
) -> DataFrame:
    """The report with a column per day, server and statistic, whatever the time ranges."""
    placed = statistics.withColumn("label", label_place(F.col("label")))
    return wide_report(placed, columns, baseline)


def extract_logs(
    spark: SparkSession,
    root: str,
    patterns: list[str],
    headers: DataFrame | None = None,
    time_column: str | None = None,
    round_files: int = ROUND_FILES,
) -> DataFrame:
    """Readings of the matching counters of all logs under ``root``, with their names."""
    found = extract_rounds(spark, root, patterns, headers, time_column, round_files)
    return found.samples.join(found.counters, ["run_id", "pos"])


def log_statistics(
    spark: SparkSession,
    root: str,
    patterns: list[str] = DEFAULT_PATTERNS,
    baseline: str = DEFAULT_BASELINE,
    keep: str = HEAD,
    headers: DataFrame | None = None,
    time_column: str | None = None,
    round_files: int = ROUND_FILES,
) -> DataFrame:
    """Statistics straight from a directory of logs.

    Goes through the same rounds as ingest, into a store of its own that keeps
    bins but no samples.
    """
    store = new_folder(spark, "bins-of-logs")
    ingest_new(
        spark,
        root,
        store,
        patterns,
        baseline,
        headers=headers,
        time_column=time_column,
        round_files=round_files,
        keep_samples=False,
    )
    return store_statistics(spark, store, baseline, keep)


def store_statistics(
    spark: SparkSession, store: str, baseline: str = DEFAULT_BASELINE, keep: str = HEAD
) -> DataFrame:
    tables = open_store(spark, store)
    return bin_statistics(tables.bins, tables.counters, baseline, keep)
