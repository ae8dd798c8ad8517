"""Relational tables seen as counter samples.

Values become whole numbers (hundredths), so that sums do not depend on the order
of rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Event types in column order and the counter each stands for.
EVENT_COUNTERS = {
    "click": "Request Execution Time",
    "purchase": "Bytes Total/sec",
    "view": "Requests/Sec",
    "signup": "Current Queue Length",
    "error": "# of Exceps Thrown",
}
LINE_COUNTERS = {
    "Quantity": "l_quantity",
    "Extended Price": "l_extendedprice",
    "Discount": "l_discount",
    "Tax": "l_tax",
}


# Declared, so that opening a table runs no job to infer them.
_SCHEMAS = {
    "events": (
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
        " l_extendedprice double, l_discount double, l_tax double, l_returnflag string,"
        " l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def hundredths(value: Column) -> Column:
    # Prices have two decimals, so no product lies between two whole numbers; ``round``
    # would go through decimals of any size.
    return F.rint(value * 100)


def day_of(ts: Column) -> Column:
    return F.substring(ts.cast("string"), 1, 10)


def event_samples(events: DataFrame, *extra: str, value: Column | None = None) -> DataFrame:
    """One run per day, three servers, one counter per event type and server."""
    if value is None:
        value = hundredths(F.col("value"))
    types = F.array(*[F.lit(t) for t in EVENT_COUNTERS])
    names = F.array(*[F.lit(c) for c in EVENT_COUNTERS.values()])
    number = F.array_position(types, F.col("event_type")).cast("int")
    server = F.col("user_id") % 3
    path = F.concat(
        F.lit("\\\\SRV"),
        server.cast("string"),
        F.lit("\\App("),
        F.col("event_type"),
        F.lit(")\\"),
        F.get(names, number - 1),
    )
    return events.select(
        day_of(F.col("ts")).alias("run_id"),
        "ts",
        (server * len(EVENT_COUNTERS) + number).cast("int").alias("pos"),
        path.alias("counter_path"),
        value.alias("value"),
        *extra,
    )


def sample_counters(samples: DataFrame) -> DataFrame:
    """The counter dictionary of samples that carry their path."""
    return samples.select("run_id", "pos", "counter_path").distinct()


def line_samples(lineitem: DataFrame) -> DataFrame:
    """Order lines in wide form: one run per ship year, one column per counter."""
    return lineitem.select(
        F.substring(F.col("l_shipdate").cast("string"), 1, 4).alias("run_id"),
        F.col("l_shipdate").alias("ts"),
        "l_orderkey",
        "l_linenumber",
        *[hundredths(F.col(column)).alias(name) for name, column in LINE_COUNTERS.items()],
    )
