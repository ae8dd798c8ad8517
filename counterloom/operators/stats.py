"""Statistics per counter.

All groupings are plain hash aggregates with a map-side part, so the rows of a
large run or counter never meet in one task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterloom.functions.numbers import (
    bytes_to_mbps,
    exact_mean,
    exact_units,
    is_byte_rate,
    mbps_name,
    merged_sum,
)
from counterloom.operators.select import match_patterns
from counterloom.operators.series import BIN_MINUTES, bin_start

HEAD = "head"
TAIL = "tail"


def run_bounds(samples: DataFrame) -> DataFrame:
    return samples.groupBy("run_id").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")
    )


def counter_stats(samples: DataFrame, by: list[str]) -> DataFrame:
    """Mean and maximum per key, nulls skipped; all-null counters have no row."""
    return (
        samples.filter(F.col("value").isNotNull())
        .groupBy(*by)
        .agg(exact_mean(F.col("value")).alias("avg"), F.max("value").alias("max"))
    )


def drop_all_null_rows(wide: DataFrame, counters: list[str]) -> DataFrame:
    """Rows with a value in at least one of the columns."""
    return wide.dropna(how="all", subset=counters)


def keep_rows(samples: DataFrame, cuts: DataFrame, keep: str = HEAD) -> DataFrame:
    """Samples up to the cut, or from the cut on; both include the cut itself.

    ``cuts`` has one row per run; settled, Catalyst knows its size and can spare
    the samples a shuffle.
    """
    joined = samples.join(cuts.select("run_id", "fall_ts"), "run_id")
    return joined.filter(_inside(keep, F.col("ts"))).drop("fall_ts")


def _inside(keep, ts):
    if keep not in (HEAD, TAIL):
        raise ValueError("keep is 'head' or 'tail'")
    return ts <= F.col("fall_ts") if keep == HEAD else ts >= F.col("fall_ts")


def bin_samples(samples: DataFrame, minutes: int = BIN_MINUTES) -> DataFrame:
    """One pass over samples: mergeable statistics per run, counter and bin.

    A cut is always the start of a bin, so bins can be kept or dropped whole
    except for samples exactly on that start; ``on_start`` keeps those apart.
    Paths stay with the bins of samples that carry them, bytes are added up.
    """
    carried = [F.sum("bytes").alias("bytes")] if "bytes" in samples.columns else []
    keys = [c for c in ("run_id", "pos", "counter_path") if c in samples.columns]
    taken = [c for c in ("ts", "value", "bytes") if c in samples.columns]
    start = bin_start(F.col("ts"), minutes)
    return (
        samples.select(*keys, *taken, start.alias("bin"))
        .groupBy(*keys, "bin", (F.col("ts") == F.col("bin")).alias("on_start"))
        .agg(
            F.count("*").alias("rows"),
            F.sum("value").alias("total"),
            exact_units(F.col("value")).alias("units"),
            F.count("value").alias("n"),
            F.max("value").alias("top"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            *carried,
        )
    )


def _binned_mean() -> Column:
    total = merged_sum(F.col("units"), F.col("total"))
    return total / F.nullif(F.sum("n"), F.lit(0))


def baseline_bins(bins: DataFrame, baselines: DataFrame) -> DataFrame:
    """Bin means of each run's baseline counter (``run_id, bin, v``)."""
    return (
        bins.join(baselines.select("run_id", "pos"), ["run_id", "pos"])
        .groupBy("run_id", "bin")
        .agg(_binned_mean().alias("v"))
    )


def binned_bounds(bins: DataFrame) -> DataFrame:
    return bins.groupBy("run_id").agg(
        F.min("first_ts").alias("start_ts"), F.max("last_ts").alias("end_ts")
    )


def binned_counters(bins: DataFrame) -> DataFrame:
    """The counter dictionary of bins that carry their paths."""
    named = bins.filter(F.col("counter_path").isNotNull())
    return named.select("run_id", "pos", "counter_path").distinct()


def kept_stats(bins: DataFrame, cuts: DataFrame, keep: str = HEAD) -> DataFrame:
    """``counter_stats`` of the samples ``keep_rows`` would keep, from bins."""
    ends = cuts.select("run_id", "fall_ts", "start_ts", "end_ts")
    inside = _inside(keep, F.col("bin"))
    if keep == HEAD:
        inside = inside & ((F.col("bin") < F.col("fall_ts")) | F.col("on_start"))
    return (
        bins.join(ends, "run_id")
        .filter(inside)
        .groupBy("run_id", "pos", "fall_ts", "start_ts", "end_ts")
        .agg(
            _binned_mean().alias("avg"),
            F.max("top").alias("max"),
        )
        .filter(F.col("avg").isNotNull())
    )


def pooled_stats(samples: DataFrame, patterns: list[str]) -> DataFrame:
    """Mean and maximum over all counters of a pattern, given to each of them.

    Samples shrink to one row per counter before patterns are looked at; the
    window holds the matched columns of one header.
    """
    per_counter = (
        samples.filter(F.col("value").isNotNull())
        .groupBy("run_id", "counter_path")
        .agg(
            F.sum("value").alias("total"),
            exact_units(F.col("value")).alias("units"),
            F.count("value").alias("n"),
            F.max("value").alias("top"),
        )
    )
    pool = Window.partitionBy("run_id", "pattern")
    return match_patterns(per_counter, patterns).select(
        "run_id",
        "pattern",
        "counter_path",
        (merged_sum(F.col("units"), F.col("total"), pool) / F.sum("n").over(pool)).alias("avg"),
        F.max("top").over(pool).alias("max"),
    )


def add_mbps_rows(stats: DataFrame) -> DataFrame:
    """Add a row in Mbps after every byte rate, in the same pass."""
    row = F.struct(*[F.col(c).alias(c) for c in ("metric", "avg", "max")])
    mbps = F.struct(
        mbps_name(F.col("metric")).alias("metric"),
        bytes_to_mbps(F.col("avg")).alias("avg"),
        bytes_to_mbps(F.col("max")).alias("max"),
    )
    rows = F.when(is_byte_rate(F.col("metric")), F.array(row, mbps)).otherwise(F.array(row))
    rest = [c for c in stats.columns if c not in ("metric", "avg", "max")]
    return stats.select(*rest, F.inline(rows))


def run_counts(stats: DataFrame) -> DataFrame:
    """Runs and statistics rows, counted in two steps."""
    return (
        stats.groupBy("run_id")
        .agg(F.count("*").alias("n"))
        .agg(F.count("*").alias("runs"), F.coalesce(F.sum("n"), F.lit(0)).alias("statistics"))
    )
