"""Wide to long, and stacking of sources."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterloom.shared import settle


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unpivot_wide(wide: DataFrame, ids: list[str], counters: list[str]) -> DataFrame:
    """One row per id and counter column; names may hold dots and brackets."""
    return wide.unpivot(
        [F.col(_quoted(c)) for c in ids],
        [F.col(_quoted(c)) for c in counters],
        "counter",
        "value",
    )


def union_runs(*runs: DataFrame) -> DataFrame:
    """Rows of all sources under the union of their columns; missing cells are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)


def numbered(df: DataFrame, order: list[str], target: str) -> DataFrame:
    """``df`` with the place of each row in a total order, from 1.

    Rows are sorted in range partitions; each partition starts behind the rows of
    those before it, so no task sees all rows.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = settle(ranged.withColumn("_part", F.spark_partition_id()), "ordered")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
    bases = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_part").orderBy(*order)
    return (
        ranged.join(bases, "_part")
        .withColumn(target, F.col("_base") + F.row_number().over(within))
        .drop("_part", "_base")
    )
