"""Shards along a Hilbert curve over several metadata columns.

Each column is quantised to ``2**BITS`` levels by rank: a value's level is the
share of rows with smaller values, so levels are evenly used, keep the order of
values, and a frequent value has one level. The index along the Hilbert curve of
the levels gives an order in which neighbours are close in every column; cut into
runs, each file spans a narrow range of each column and scans can skip files by
their minima and maxima. Rows with one index follow in the order of the tie
columns, so a frequent combination is spread over as many runs as it fills.

Two laws cut the runs: ``rows`` (counts at most one apart) and ``bytes`` (sizes
near equal: every border is at most one row off its ideal place).

Only DataFrame functions are used. Positions in the order come from sums per
range partition, never from one task over all rows.

Defined cases: nulls are the smallest value of a column. A null text has no
bytes and the checksum of an empty one. Repeated rows take neighbouring slots.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterloom.shared import settle

SHARDS = 40
BITS = 10
ROW_BYTES = 16
ROWS, BYTES = "rows", "bytes"


def running_sums(df: DataFrame, order: list[str], weights: list[str]) -> DataFrame:
    """``df`` in a total order with ``_before_<w>``: the sum of w over all earlier rows.

    Rows are sorted in range partitions; a partition starts at the sum of those
    before it (one row per partition), a row at the sum within its partition.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = settle(ranged.withColumn("_part", F.spark_partition_id()), "ordered")
    sums = ranged.groupBy("_part").agg(*[F.sum(w).alias(f"_sum_{w}") for w in weights])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        "_part",
        *[F.coalesce(F.sum(f"_sum_{w}").over(earlier), F.lit(0)).alias(f"_base_{w}") for w in weights],
    )
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    # One row per range partition: broadcasting it is bounded by their number.
    placed = ranged.join(F.broadcast(bases), "_part")
    for w in weights:
        inner = F.coalesce(F.sum(w).over(within), F.lit(0))
        placed = placed.withColumn(f"_before_{w}", F.col(f"_base_{w}") + inner)
    return placed.drop("_part", *[f"_base_{w}" for w in weights])


def levels(df: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """``_value, _level`` of every distinct value of a column."""
    counts = df.groupBy(F.col(column).alias("_value")).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*").alias("n")).first().n
    ranks = running_sums(counts, ["_value"], ["_n"])
    level = F.floor(F.col("_before__n") * F.lit(1 << bits) / F.lit(max(total, 1)))
    return settle(ranks.select("_value", level.cast("long").alias("_level")), "levels")


def _has(value: Column, mask: Column) -> Column:
    return value.bitwiseAND(mask) != 0


def hilbert_index(df: DataFrame, columns: list[str], target: str, bits: int = BITS) -> DataFrame:
    """``df`` with the position of integer ``columns`` along the Hilbert curve.

    Bits are handled from the highest down: where an axis has the bit, the lower
    bits of the first axis are flipped, otherwise they are exchanged with those of
    that axis. A Gray code over the axes and bits follows, then the bits of the
    axes are interleaved.
    """
    axes = range(len(columns))
    masks = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]).cast("array<bigint>")
    numbers = F.array(*[F.lit(i) for i in axes])

    def turn(state: Column, mask: Column, axis: Column) -> Column:
        low = mask - 1
        own = F.get(state, axis)
        swap = F.get(state, F.lit(0)).bitwiseXOR(own).bitwiseAND(low)
        # For the first axis itself there is nothing to exchange: swap is zero.
        return F.transform(
            state,
            lambda v, i: F.when(_has(own, mask), F.when(i == 0, v.bitwiseXOR(low)).otherwise(v))
            .when((i == 0) | (i == axis), v.bitwiseXOR(swap))
            .otherwise(v),
        )

    start = F.array(*[F.col(c).cast("bigint") for c in columns])
    turned = F.aggregate(
        masks,
        start,
        lambda state, mask: F.aggregate(
            numbers, state, lambda inner, axis: turn(inner, mask, axis)
        ),
    )
    gray = F.transform(
        F.col("_turned"),
        lambda _, i: F.aggregate(
            F.slice("_turned", 1, i + 1), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseXOR(b)
        ),
    )
    flip = F.aggregate(
        masks,
        F.lit(0).cast("bigint"),
        lambda acc, mask: F.when(
            _has(F.element_at("_gray", -1), mask), acc.bitwiseXOR(mask - 1)
        ).otherwise(acc),
    )
    steps = F.array(
        *[
            F.struct(F.lit(1 << b).cast("bigint").alias("mask"), F.lit(i).alias("axis"))
            for b in range(bits - 1, -1, -1)
            for i in axes
        ]
    )
    index = F.aggregate(
        steps,
        F.lit(0).cast("bigint"),
        lambda acc, s: acc * 2
        + _has(F.get("_gray", s.axis).bitwiseXOR(F.col("_flip")), s.mask).cast("bigint"),
    )
    return (
        df.withColumn("_turned", turned)
        .withColumn("_gray", gray)
        .withColumn("_flip", flip)
        .withColumn(target, index)
        .drop("_turned", "_gray", "_flip")
    )


def curve(df: DataFrame, dimensions: list[str], bits: int = BITS) -> DataFrame:
    """``df`` with ``_curve``, the index of its quantised dimensions."""
    names = []
    for number, dimension in enumerate(dimensions):
        names.append(f"_axis{number}")
        level = levels(df, dimension, bits).withColumnRenamed("_level", names[-1])
        df = df.join(level, F.col(dimension).eqNullSafe(F.col("_value")), "left").drop("_value")
    return hilbert_index(df, names, "_curve", bits).drop(*names)


def cut_runs(
    df: DataFrame, size: str, ties: list[str], shards: int = SHARDS, law: str = ROWS
) -> DataFrame:
    """``df`` with ``_curve`` cut into ``shards`` runs: adds ``shard`` and ``slot``."""
    weighted = df.withColumn("_one", F.lit(1).cast("long")).withColumn("_size", F.col(size))
    order = ["_curve", *ties]
    placed = settle(running_sums(weighted, order, ["_one", "_size"]), "placed")
    totals = placed.agg(F.count("*").alias("n"), F.sum("_size").alias("size")).first()
    row, n = F.col("_before__one"), f"{max(totals.n, 1)}L"
    if law == ROWS:
        shard = F.expr(f"_before__one * {shards} div {n}")
        first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
        cut = placed.withColumn("shard", shard.cast("int")).withColumn("slot", row - first)
    else:
        shard = F.expr(f"_before__size * {shards} div {max(totals.size or 0, 1)}L")
        cut = placed.withColumn("shard", F.least(shard, F.lit(shards - 1)).cast("int"))
        firsts = cut.groupBy("shard").agg(F.min("_before__one").alias("_first"))
        # At most one row per shard.
        cut = cut.join(F.broadcast(firsts), "shard").withColumn("slot", row - F.col("_first"))
    return cut.drop("_one", "_size", "_before__one", "_before__size", "_first", "_curve")


def write_shards(
    df: DataFrame,
    folder: str,
    dimensions: list[str],
    ties: list[str],
    shards: int = SHARDS,
    law: str = BYTES,
    text: str = "text",
) -> None:
    """All columns of ``df`` as parquet, one folder per shard, rows in the order of slots."""
    axes = [F.col(name).alias(f"_dim{i}") for i, name in enumerate(dimensions)]
    last = [F.col(name).alias(f"_tie{i}") for i, name in enumerate(ties)]
    row = F.struct(*[F.col(c) for c in df.columns]).alias("_row")
    curved = curve(
        df.select(row, text_bytes(text).alias("_bytes"), *axes, *last),
        [f"_dim{i}" for i in range(len(axes))],
    )
    cut = cut_runs(curved, "_bytes", [f"_tie{i}" for i in range(len(last))], shards, law)
    placed = cut.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    placed = placed.select(F.col("shard").alias("hilbert_shard"), "_row.*")
    placed.write.partitionBy("hilbert_shard").parquet(folder)


def text_bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def document_shards(
    docs: DataFrame,
    dimensions: list[str],
    doc_id: str = "doc_id",
    text: str = "text",
    shards: int = SHARDS,
    law: str = ROWS,
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``; texts are not moved."""
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    axes = [F.col(name).alias(f"_dim{number}") for number, name in enumerate(dimensions)]
    slim = docs.select(
        F.col(doc_id).alias("doc_id"), text_bytes(text).alias("size"), crc.alias("text_crc32"), *axes
    )
    slim = settle(slim, "slim")
    # Settled: dealing rows by ranges of the index reads them twice.
    curved = settle(curve(slim, [f"_dim{number}" for number in range(len(dimensions))]), "curved")
    cut = cut_runs(curved, "size", ["doc_id", "text_crc32", "size"], shards, law)
    return cut.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(law).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
