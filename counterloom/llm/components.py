"""Connected components of a link table, as Spark jobs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterloom.shared import discard, settle


def _links(df: DataFrame) -> DataFrame:
    """Distinct links from the larger end ``u`` to the smaller end ``v``."""
    return (
        df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter(F.col("u") != F.col("v"))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of all nodes with a link (``u, v`` long) whose root is another node.

    The root is the smallest node of the component. Alternates two steps until
    nothing changes: every node sends its larger neighbours, then its smaller ones,
    to the smallest node that it knows. Depth shrinks geometrically; every round
    is a table in the shared folder, so lineage stays short. Links of a hub are
    joined, never gathered in one task.
    """
    current = settle(_links(links), "links")
    mark = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("root"))
        up = both.join(least, "u").filter(F.col("v") > F.col("u"))
        large = settle(_links(up.select(F.col("v").alias("u"), F.col("root").alias("v"))), "links")
        discard(current)
        least = large.groupBy("u").agg(F.min("v").alias("root"))
        pairs = large.join(least, "u")
        down = pairs.select(F.col("v").alias("u"), F.col("root").alias("v"))
        current = settle(_links(down.union(pairs.select("u", F.col("root").alias("v")))), "links")
        discard(large)
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
