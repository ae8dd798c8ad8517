"""Binned series and the cut of a run.

Windows here order the bins of one run. A run has at most one row per bin of its
calendar span (105,120 five-minute bins a year) whatever its number of samples,
because samples are averaged into bins by a partial aggregate first.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterloom.functions.numbers import exact_mean
from counterloom.schema import NO_CHANGE, NO_PREVIOUS_BIN, OK

BIN_MINUTES = 5
_DAY_MINUTES = 24 * 60


def bin_start(ts: Column, minutes: int = BIN_MINUTES) -> Column:
    """Start of the left-closed bin that holds ``ts``; widths divide a day.

    A null time stamp has a null bin, so lines without a time can be counted.
    """
    if minutes < 1 or _DAY_MINUTES % minutes:
        raise ValueError("the bin width must divide 24 hours")
    of_day = F.hour(ts) * 60 + F.minute(ts)
    whole = (F.floor(of_day / minutes) * minutes).cast("int")
    return ts.cast("date").cast("timestamp_ntz") + F.make_dt_interval(mins=whole)


def _minutes(count: int) -> Column:
    return F.make_dt_interval(mins=F.lit(count))


def resample_mean(samples: DataFrame, by: list[str], minutes: int = BIN_MINUTES) -> DataFrame:
    """Mean per key and bin, nulls skipped."""
    timed = samples.filter(F.col("ts").isNotNull())
    return timed.groupBy(*by, bin_start(F.col("ts"), minutes).alias("bin")).agg(
        exact_mean(F.col("value")).alias("v")
    )


def nonzero(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value is not zero; nulls pass."""
    return df.filter((F.col(column) != 0) | F.col(column).isNull())


def nonzero_min(samples: DataFrame, by: list[str]) -> DataFrame:
    value = F.col("value")
    return samples.groupBy(*by).agg(F.min(F.when(value != 0, value)).alias("min_nonzero"))


def _changes(bins: DataFrame) -> DataFrame:
    """Non-zero bins with the bin before them and the change to the next one."""
    order = Window.partitionBy("run_id").orderBy("bin")
    observed = bins.filter(F.col("v").isNotNull()).select(
        "run_id",
        "bin",
        "v",
        F.lag("bin").over(order).alias("prev_bin"),
        F.lag("v").over(order).alias("prev_v"),
    )
    later = F.lead("v").over(order)
    return observed.filter(F.col("v") != 0).withColumn(
        "diff_pct", F.abs((F.col("v") - later) / later) * 100
    )


def pct_change(bins: DataFrame) -> DataFrame:
    """Absolute change in percent from each non-zero bin to the next later one."""
    return _changes(bins).filter(F.col("diff_pct").isNotNull()).select(
        "run_id", "bin", "v", "diff_pct"
    )


def find_cut(
    bins: DataFrame,
    bounds: DataFrame,
    minutes: int = BIN_MINUTES,
    require_previous: bool = True,
) -> DataFrame:
    """Logical end of each run: the end of the bin with the largest change.

    ``bins`` holds the baseline means (``run_id, bin, v``), ``bounds`` the first and
    last time stamps of each run (``run_id, start_ts, end_ts``). Ties go to the
    earliest bin.
    The bin before the chosen one must lie inside the run and must not be a zero
    bin; an empty one is accepted and gives a null ``prev_value``. Runs without a
    non-zero bin have no row.
    """
    change = F.coalesce(-F.col("diff_pct"), F.lit(float("inf")))
    best = (
        _changes(bins)
        .groupBy("run_id")
        .agg(
            F.min_by(
                F.struct("bin", "v", "prev_bin", "prev_v", "diff_pct"), F.struct(change, "bin")
            ).alias("best")
        )
        .select("run_id", "best.*")
    )
    before = F.col("bin") - _minutes(minutes)
    adjacent = F.coalesce(F.col("prev_bin") == before, F.lit(False))
    accepted = (before >= F.col("first_bin")) & ~(adjacent & (F.col("prev_v") == 0))
    status = F.when(F.col("diff_pct").isNull(), NO_CHANGE)
    if require_previous:
        status = status.when(~accepted, NO_PREVIOUS_BIN)
    first_bins = bounds.select(
        "run_id", "start_ts", "end_ts", bin_start(F.col("start_ts"), minutes).alias("first_bin")
    )
    return best.join(first_bins, "run_id").select(
        "run_id",
        (F.col("bin") + _minutes(minutes)).alias("fall_ts"),
        "start_ts",
        "end_ts",
        F.when(adjacent, F.col("prev_v")).alias("prev_value"),
        F.col("v").alias("value"),
        "diff_pct",
        status.otherwise(OK).alias("status"),
    )
