"""Choice of counters by name.

These work on the counter dictionary (one row per run and column), never on
samples. Patterns are a short argument list and become literals of the plan, so
matching needs no join.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterloom.functions.paths import contains_any, path_metric, path_server
from counterloom.schema import TICK


def describe_counters(counters: DataFrame) -> DataFrame:
    """Add ``server`` and ``metric`` to a dictionary that holds ``counter_path``."""
    path = F.col("counter_path")
    return counters.withColumn("server", path_server(path)).withColumn("metric", path_metric(path))


def select_by_substring(df: DataFrame, pattern: str) -> DataFrame:
    return df.filter(F.contains("counter_path", F.lit(pattern)))


def select_any(df: DataFrame, patterns: list[str]) -> DataFrame:
    return df.filter(contains_any(F.col("counter_path"), patterns))


def _numbered(patterns: list[str]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(i).alias("pattern_no"), F.lit(p).alias("pattern"))
            for i, p in enumerate(dict.fromkeys(patterns))
        ]
    )


def match_patterns(counters: DataFrame, patterns: list[str]) -> DataFrame:
    """One row per counter and pattern it contains."""
    hits = F.filter(_numbered(patterns), lambda p: F.contains("counter_path", p.pattern))
    return counters.select("*", F.inline(hits))


def match_counts(counters: DataFrame, patterns: list[str]) -> DataFrame:
    """Number of matches per run; a counter counts once for each pattern."""
    return match_patterns(counters, patterns).groupBy("run_id").agg(F.count("*").alias("matches"))


def dedupe_counters(counters: DataFrame, patterns: list[str]) -> DataFrame:
    """Matched counters of each run once, in order of first pattern, then position.

    The window holds the distinct matched columns of one header.
    """
    first = (
        match_patterns(counters, patterns)
        .groupBy("run_id", "counter_path")
        .agg(F.min(F.struct("pattern_no", "pos")).alias("first"))
    )
    order = Window.partitionBy("run_id").orderBy("first", "counter_path")
    return first.select(
        "run_id",
        "counter_path",
        F.col("first.pattern_no").alias("pattern_no"),
        F.col("first.pos").alias("pos"),
        F.row_number().over(order).alias("position"),
    )


def baseline_counters(counters: DataFrame, baseline: str) -> DataFrame:
    """The first counter of each run whose path contains ``baseline``."""
    first = F.min(F.struct("pos", "counter_path"))
    return (
        select_by_substring(counters, baseline)
        .groupBy("run_id")
        .agg(first.alias("first"))
        .select(
            "run_id",
            F.col("first.pos").alias("pos"),
            F.col("first.counter_path").alias("baseline_path"),
        )
    )


def extract_counters(samples: DataFrame, patterns: list[str]) -> DataFrame:
    """Samples of the matching counters of all runs in one long table."""
    return select_any(samples, patterns).select("run_id", "ts", "pos", "counter_path", "value")


def tick_others(samples: DataFrame, patterns: list[str]) -> DataFrame:
    """Readings of the matching counters; the others become tick rows.

    Run bounds count every line of a log, so time stamps must stay.
    """
    wanted = contains_any(F.col("counter_path"), patterns)
    return samples.select(
        "run_id",
        "ts",
        F.when(wanted, F.col("pos")).otherwise(TICK).alias("pos"),
        F.when(wanted, F.col("counter_path")).alias("counter_path"),
        F.when(wanted, F.col("value")).alias("value"),
    )
