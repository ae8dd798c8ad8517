"""Run bookkeeping: what is new, what became of each run, and how many."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterloom.schema import EMPTY, NO_BASELINE, NO_NONZERO, NO_TIME_COLUMN


def new_runs(found: DataFrame, manifest: DataFrame, version: list[str] = ["run_id"]) -> DataFrame:
    """Runs that have not been ingested yet, by the columns that tell versions apart."""
    return found.join(manifest.select(*version), version, "left_anti")


def run_status(runs: DataFrame, baselines: DataFrame, cuts: DataFrame) -> DataFrame:
    """One row per run with the reason why it has no cut, or ``ok``.

    ``runs`` has ``run_id, time_column, rows``. All inputs have one row per run.
    """
    status = (
        F.when(F.col("time_column").isNull(), NO_TIME_COLUMN)
        .when(F.col("rows") == 0, EMPTY)
        .when(F.col("baseline_path").isNull(), NO_BASELINE)
        .when(F.col("cut_status").isNull(), NO_NONZERO)
        .otherwise(F.col("cut_status"))
    )
    return (
        runs.withColumn("rows", F.coalesce("rows", F.lit(0)))
        .join(baselines.select("run_id", "baseline_path"), "run_id", "left")
        .join(
            cuts.select("run_id", "fall_ts", F.col("status").alias("cut_status")), "run_id", "left"
        )
        .withColumn("status", status)
        .drop("cut_status")
    )


def ingest_report(manifest: DataFrame) -> DataFrame:
    """Runs and rows per status."""
    return manifest.groupBy("status").agg(
        F.count("*").alias("runs"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")
    )
