"""Near duplicates by SimHash fingerprints and pivot distance tables.

Equal fingerprints are collapsed first. For the rest, a table of Hamming
distances to reference fingerprints (pivots) is computed once per fingerprint; by
the triangle inequality two fingerprints further apart than the limit in any
coordinate cannot be linked, and only pairs that survive all coordinates are
compared bit by bit. A pivot table alone would have to look at all pairs, so
fingerprints meet in buckets: the bits are cut into ``radius + 2`` blocks, and a
pair that differs in at most ``radius`` bits agrees on at least two of them. Every
fingerprint stands in one bucket per pair of blocks. A bucket emits the links of
a spanning forest, never all its pairs. A bucket of more than ``chunk``
fingerprints is cut into chunks by hash and every two chunks meet in a task of
their own, so no bucket has to fit one task and none is left out.

Defined cases: a null or blank text has fingerprint zero and is linked like any
other. Repeated rows each get a row. A null id never becomes a component id
while the component holds another; a component of null ids only has a null id.
Only the named columns are read.
"""

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterloom.llm.components import components
from counterloom.llm.ship import ship
from counterloom.shared import discard, settle

SEED = 42
SHINGLE = 4
RADIUS = 4
PIVOTS = 32
CHUNK = 8_000
PARTITION_ROWS = 500_000
_SLICE = 1 << 16


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; each is set if over half of the shingles' hashes have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(word) + 1 for word in words))
    starts = [0, *ends]
    last = max(1, len(words) - shingle + 1)
    set_bits = np.zeros(64, dtype=np.int64)
    for first in range(0, last, _SLICE):
        spans = zip(starts[first : min(first + _SLICE, last)], ends[first + shingle - 1 :] or ends[-1:])
        hashes = [xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in spans]
        octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << bit for bit in range(64) if 2 * int(set_bits[bit]) > last)


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """SimHash of the whole text as a (signed) long."""

    def hashed(texts: pa.Array) -> pa.Array:
        prints = [text_fingerprint(value.as_py(), shingle) for value in texts]
        return pa.array(np.array(prints, dtype=np.uint64).view(np.int64))

    return F.arrow_udf(hashed, T.LongType()).asNondeterministic()(text)


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of the first numbers."""
    numbers = [xxhash.xxh64_intdigest(str(i), SEED) for i in range(count)]
    return np.array(numbers, dtype=np.uint64)


def pivot_table(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Row p: Hamming distances of all fingerprints to reference p."""
    return np.stack([np.bitwise_count(prints ^ p) for p in references]).astype(np.int16)


def forest(
    buckets: np.ndarray, prints: np.ndarray, references: np.ndarray, radius: int
) -> list[tuple[int, int]]:
    """Links that span the components of every bucket, as positions in ``prints``.

    Rows are sorted by bucket and distance to the first pivot. At offset d, row i
    is compared with row i + d and leaves the scan for good once the bucket ends or
    the first coordinate differs too much. Other coordinates thin the pairs out,
    then come pairs already connected, then the bits themselves.
    """
    table = pivot_table(prints, references)
    order = np.lexsort((table[0], buckets))
    buckets, prints, table = buckets[order], prints[order], table[:, order]
    parent = np.arange(len(prints))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    links, left, offset = [], np.arange(len(prints)), 0
    while True:
        offset += 1
        left = left[left + offset < len(prints)]
        right = left + offset
        near = (buckets[left] == buckets[right]) & (table[0][right] - table[0][left] <= radius)
        left = left[near]
        if not len(left):
            return [(int(order[a]), int(order[b])) for a, b in links]
        a, b = left, left + offset
        for row in table[1:]:
            keep = np.abs(row[a] - row[b]) <= radius
            a, b = a[keep], b[keep]
            if not len(a):
                break
        apart = parent[a] != parent[b]
        a, b = a[apart], b[apart]
        close = np.bitwise_count(prints[a] ^ prints[b]) <= radius
        for i, j in zip(a[close].tolist(), b[close].tolist()):
            one, two = top(i), top(j)
            if one != two:
                parent[max(one, two)] = min(one, two)
                parent[i] = parent[j] = min(one, two)
                links.append((i, j))


def _bucket_links(references: np.ndarray, radius: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[column.to_numpy() for column in batch.columns] for batch in batches]
        if parts:
            buckets, prints = (np.concatenate(c) for c in zip(*parts))
            prints = prints.view(np.uint64)
            links = forest(buckets, prints, references, radius)
            u = prints[[a for a, _ in links]].view(np.int64)
            v = prints[[b for _, b in links]].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return linked


def block_pairs(radius: int) -> list[tuple[int, int]]:
    """Masks of two blocks out of ``radius + 2``, numbered."""
    edges = [64 * i // (radius + 2) for i in range(radius + 3)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return list(enumerate(a | b for a, b in combinations(masks, 2)))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def print_links(
    prints: DataFrame,
    radius: int = RADIUS,
    references: int = PIVOTS,
    chunk: int = CHUNK,
    partition_rows: int = PARTITION_ROWS,
) -> DataFrame:
    """Links ``u, v`` that connect all fingerprints at most ``radius`` bits apart.

    ``prints``: a settled table of distinct ``fp``.
    """
    spark = prints.sparkSession
    ship(spark)
    places = [
        F.xxhash64(F.lit(number), F.col("fp").bitwiseAND(F.lit(_signed(mask))))
        for number, mask in block_pairs(radius)
    ]
    rows = prints.select(F.explode(F.array(*places)).alias("bucket"), "fp")
    large = rows.groupBy("bucket").count().filter(F.col("count") > chunk)
    large = settle(large.select("bucket", F.ceil(F.col("count") / chunk).alias("n")), "buckets")
    spread = rows.join(large, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    own = F.pmod(F.xxhash64(F.lit(SEED), "fp"), F.col("n"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    met = spread.withColumn("own", own).withColumn("other", other)
    met = met.select(
        F.when(F.col("n") == 1, F.col("bucket"))
        .otherwise(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")))
        .alias("bucket"),
        "fp",
    )
    tasks = max(1, ceil(prints.count() * len(places) / partition_rows))
    tasks = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return met.repartition(tasks, "bucket").mapInArrow(
        _bucket_links(pivots(references), radius), "u long, v long"
    )


def _components(
    docs: DataFrame, doc_id: str, text: str, shingle: int, radius: int
) -> tuple[DataFrame, DataFrame]:
    """Settled ``doc_id, key, fp`` of every row and ``fp, root, component_id``.

    ``key`` tells apart texts that share an id.
    """
    ship(docs.sparkSession)
    marked = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(text).alias("key"),
        fingerprint(F.col(text), shingle).alias("fp"),
    )
    marked = settle(marked, "fingerprints")
    firsts = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = components(print_links(firsts.select("fp"), radius))
    grouped = firsts.join(roots, firsts.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    grouped = settle(grouped, "grouped")
    discard(firsts)
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(smallest, "root").select("fp", "root", "component_id")
    return marked, settle(named, "components")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    marked, named = _components(docs, doc_id, text, shingle, radius)
    return marked.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def drop_near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
) -> DataFrame:
    """One document of every component, the one with the smallest id, as it was.

    Of several rows with that id one stays; rows without an id all stay.
    """
    marked, named = _components(docs, doc_id, text, shingle, radius)
    first = F.min(F.struct("doc_id", "key")).alias("first")
    kept = (
        marked.join(named, "fp")
        .filter(F.col("doc_id") == F.col("component_id"))
        .groupBy("root")
        .agg(first)
        .select(F.col("first.doc_id").alias("_id"), F.col("first.key").alias("_key"))
        .distinct()
    )
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_key"))
    chosen = rows.join(kept, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"])
    unknown = rows.filter(F.col("_id").isNull())
    return chosen.unionByName(unknown).select("_row.*")
