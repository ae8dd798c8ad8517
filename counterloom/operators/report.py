"""Labels, combination of runs, and the wide report."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterloom.functions.numbers import exact_mean, round_half_even
from counterloom.functions.paths import path_metric
from counterloom.functions.times import column_label
from counterloom.operators.reshape import numbered
from counterloom.operators.select import describe_counters, select_by_substring
from counterloom.operators.stats import HEAD, add_mbps_rows
from counterloom.schema import AVG, MAX


def _stat_rows(stats: DataFrame, day: Column, start: Column, end: Column) -> DataFrame:
    pairs = F.array(
        F.struct(F.lit(AVG).alias("stat"), F.col("avg").alias("value")),
        F.struct(F.lit(MAX).alias("stat"), F.col("max").alias("value")),
    )
    label = column_label(day, F.col("server"), F.col("stat"), start, end)
    return stats.select("*", F.inline(pairs)).select(
        "run_id", "pos", "server", "metric", "stat", label.alias("label"), "value"
    )


def labelled_stats(stats: DataFrame, keep: str = HEAD) -> DataFrame:
    """Two rows (average, maximum) per statistic, with the label of its column."""
    start, end = ("start_ts", "fall_ts") if keep == HEAD else ("fall_ts", "end_ts")
    return _stat_rows(stats, F.col("fall_ts"), F.col(start), F.col(end))


def pattern_statistics(
    samples: DataFrame, pattern: str, day: Column, start: Column, end: Column
) -> DataFrame:
    """Labelled statistics of the counters of one pattern, for a given time range.

    ``day``, ``start`` and ``end`` may use ``start_ts`` and ``end_ts`` of the run's
    matching samples.
    """
    keys = ["run_id", "pos", "counter_path"]
    found = (
        select_by_substring(samples, pattern)
        .groupBy(*keys)
        .agg(
            exact_mean(F.col("value")).alias("avg"),
            F.max("value").alias("max"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
    )
    run = Window.partitionBy("run_id")
    bounds = {"start_ts": F.min("first_ts").over(run), "end_ts": F.max("last_ts").over(run)}
    named = add_mbps_rows(describe_counters(found.filter(F.col("avg").isNotNull()).withColumns(bounds)))
    return _stat_rows(named, day, start, end)


def first_by_label(stats: DataFrame) -> DataFrame:
    """One value per metric and label: that of the first run and counter."""
    return (
        stats.filter(F.col("value").isNotNull())
        .groupBy("metric", "label")
        .agg(F.min_by("value", F.struct("run_id", "pos")).alias("value"))
    )


def label_place(label: Column) -> Column:
    """``05-Feb SRV1 Avg``: day, server and statistic of a label, without its time range."""
    return F.replace(F.concat_ws(" ", F.slice(F.split(label, "\n"), 1, 3)), F.lit("."), F.lit(""))


def round_report(cells: DataFrame) -> DataFrame:
    return cells.withColumn("value", round_half_even(F.col("value")))


def baseline_first(metric: Column, baseline: str) -> list[Column]:
    """Sort keys that put the baseline row on top and the others in name order.

    ``baseline`` may be given with or without its server.
    """
    return [(metric == _baseline_metric(baseline)).desc(), metric.asc()]


def _baseline_metric(baseline: str) -> Column:
    name = F.lit(baseline)
    return F.when(F.startswith(name, F.lit("\\\\")), path_metric(name)).otherwise(name)


def row_places(cells: DataFrame, baseline: str) -> DataFrame:
    """``metric, is_baseline, place``: the order of the report's rows, from 1.

    Metrics are names from headers, a few thousand at most, so one task can number
    them.
    """
    metrics = cells.select("metric").distinct()
    order = Window.orderBy(*baseline_first(F.col("metric"), baseline))
    return metrics.select(
        "metric",
        (F.col("metric") == _baseline_metric(baseline)).alias("is_baseline"),
        F.row_number().over(order).alias("place"),
    )


def pivot_report(
    cells: DataFrame, baseline: str, columns: list[str], key: str = "label"
) -> DataFrame:
    """Metrics as rows, the given values of ``key`` as columns, baseline first.

    ``is_baseline`` marks the pinned row. Columns without a cell stay, empty; the
    caller names them, so building the plan runs no job and sets no limit.
    """
    order = baseline_first(F.col("metric"), baseline)
    wide = cells.groupBy("metric").pivot(key, columns).agg(F.first("value", ignorenulls=True))
    pinned = F.col("metric") == _baseline_metric(baseline)
    return wide.withColumn("is_baseline", pinned).orderBy(*order)


def label_dictionary(cells: DataFrame, key: str = "label") -> DataFrame:
    """``label, column``: every label of the cells with its column number, from 1."""
    return numbered(cells.select(F.col(key).alias("label")).distinct(), ["label"], "column")


def unlisted_cells(cells: DataFrame, columns: list[str], key: str = "label") -> DataFrame:
    """``label, cells``: what a report with the given columns leaves out."""
    return (
        cells.filter(~F.col(key).isin(columns))
        .groupBy(F.col(key).alias("label"))
        .agg(F.count("*").alias("cells"))
    )


def aligned_rows(cells: DataFrame, labels: DataFrame, baseline: str) -> DataFrame:
    """``metric, is_baseline, values``: a row per metric, its values in column order.

    ``labels`` comes from ``label_dictionary``; the width of the report is the number
    of its rows, whatever that is. A row holds one cell per label of its metric;
    the gaps between them are filled with nulls in one pass over the row.
    """
    placed = cells.join(labels, cells.label == labels.label).select("metric", "column", "value")
    found = F.array_sort(F.collect_list(F.struct("column", "value")))
    width = labels.agg(F.max("column")).scalar()
    empty = F.lit(None).cast("double")

    def with_gap(cell: Column, i: Column) -> Column:
        before = F.coalesce(F.get(F.col("found"), i - 1).column, F.lit(0))
        return F.concat(F.array_repeat(empty, (cell.column - before - 1).cast("int")), F.array(cell.value))

    tail = (width - F.element_at("found", -1).column).cast("int")
    values = F.concat(F.flatten(F.transform("found", with_gap)), F.array_repeat(empty, tail))
    return placed.groupBy("metric").agg(found.alias("found")).select(
        "metric",
        (F.col("metric") == _baseline_metric(baseline)).alias("is_baseline"),
        values.alias("values"),
    )
