"""Near duplicates by b-bit MinHash.

A document is the set of its distinct shingles. Its sketch holds the minima of
``HASHES`` hash functions. Bands of ``BAND_ROWS`` whole minima make the candidates;
then only the lowest ``BITS`` bits of every minimum are kept, packed into words, and
the similarity of a pair is estimated from the number of equal groups of bits,
corrected for groups that are equal by chance. What the estimate lets pass is
compared set by set.

Two sets of similarity s meet in no band with probability ``(1 - s^r)^b``: 5e-8 for
four rows, 32 bands and s = 0.8. The estimate lets a pair pass that lies up to five
standard deviations below the limit, which turns away 3e-7 of those at the limit.

Equal sets are collapsed first. A bucket never emits all its pairs:

- sets that share a band are joined into clusters by links that span the pairs
  which the estimate lets pass;
- a bucket of more than ``CHUNK`` sets is split further, each set by each of its
  other bands; buckets that are still larger hold near copies and become stars,
  which makes clusters coarser, not results;
- true links lie within clusters. The sets of a cluster meet in tasks of bounded
  size. A cluster of several parts meets part by part, with the same few sets in
  every part; then only what lies outside the largest class so found meets all
  other parts.

Shingles are compared by 64-bit hashes, sets are collapsed by 128 bits.

Defined cases: a null or blank text has an empty set and is linked with nothing; a
text of fewer words than a shingle is one shingle. Repeated rows each get a row.
The component of rows without an id has a null id and its rows are kept; in a
component with other rows they are not. Only the named columns are read.
"""

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterloom.llm.components import components
from counterloom.llm.ship import ship
from counterloom.shared import settle

SEED = 42
SHINGLE = 5
PERCENT = 80
HASHES = 128
BAND_ROWS = 4
BITS = 4
CHUNK = 4000
# Shingles of one part of a cluster: what one task compares at a time.
PART_SHINGLES = 4_000_000
PIVOTS = 8
SLACK = 5.0
_SLICE = 2048
_WORD = 64 // BITS
_GROUPS = np.uint64(sum(1 << (BITS * i) for i in range(_WORD)))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _factors() -> tuple[np.ndarray, np.ndarray]:
    numbers = [xxhash.xxh64_intdigest(str(i), SEED) for i in range(2 * HASHES)]
    values = np.array(numbers, dtype=np.uint64)
    return values[:HASHES] | np.uint64(1), values[HASHES:]


class _Hashes(dict):
    """Hash of each word met so far; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


_known = _Hashes()


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(_known.__getitem__, words), dtype=np.uint64, count=len(words))
    last = max(1, len(words) - shingle + 1)
    mixed = np.full(last, len(words) < shingle, dtype=np.uint64)
    for i in range(min(shingle, len(words))):
        mixed = (mixed + hashes[i : i + last]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def minima(shingles: np.ndarray) -> np.ndarray:
    factors, shifts = _factors_kept
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), _SLICE):
        part = shingles[start : start + _SLICE, None] * factors + shifts
        np.minimum(least, part.min(axis=0), out=least)
    return least


_factors_kept = _factors()


def packed(least: np.ndarray) -> np.ndarray:
    """The lowest bits of the minima (mixed first), ``_WORD`` of them in a word."""
    low = ((least ^ (least >> np.uint64(32))) * _MIX) >> np.uint64(64 - BITS)
    places = np.arange(_WORD, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low.reshape(-1, _WORD) << places, axis=1)


def band_keys(least: np.ndarray) -> list[int]:
    bands = least.reshape(-1, BAND_ROWS)
    return [
        xxhash.xxh3_64_intdigest(band.tobytes(), number) - (1 << 63)
        for number, band in enumerate(bands)
    ]


def equal_groups(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many groups of bits are equal in each row of two tables of signatures."""
    apart = a ^ b
    for step in (1, 2)[: BITS // 2]:
        apart = apart | (apart >> np.uint64(step))
    return HASHES - np.bitwise_count(apart & _GROUPS).sum(axis=1, dtype=np.int64)


def least_equal(percent: int) -> int:
    """Fewest equal groups of a pair that may still reach the similarity."""
    chance = 1 / (1 << BITS)
    equal = percent / 100 + (1 - percent / 100) * chance
    return ceil(HASHES * equal - SLACK * sqrt(HASHES * equal * (1 - equal)))


_SKETCH = T.StructType(
    [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_key", T.BinaryType()),
        T.StructField("signature", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)


def sketch(text: Column, shingle: int) -> Column:
    """Size, digest, packed signature and band keys of the shingle set of a text."""

    def described(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts:
            found = shingle_set(value.as_py(), shingle)
            if len(found):
                least = minima(found)
                key = xxhash.xxh3_128_digest(found.tobytes())
                rows.append((len(found), key, packed(least).tobytes(), band_keys(least)))
            else:
                rows.append((0, None, None, None))
        sizes, keys, signatures, bands = zip(*rows) if rows else ((), (), (), ())
        return pa.StructArray.from_arrays(
            [
                pa.array(sizes, pa.int64()),
                pa.array(keys, pa.binary()),
                pa.array(signatures, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
            ],
            ["n_shingles", "set_key", "signature", "bands"],
        )

    return F.arrow_udf(described, _SKETCH).asNondeterministic()(text)


def _alike(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(two) - both)


def spanning_links(
    sizes: np.ndarray,
    signatures: np.ndarray,
    classes: np.ndarray,
    percent: int,
    sets: list[np.ndarray] | None = None,
) -> list[tuple[int, int]]:
    """Links, as positions, that span what is alike and not yet of one class.

    Without ``sets`` alike is what the estimate lets pass, with them the sets
    decide. Rows are ordered by size; at offset d every row meets the row d places
    on, and leaves the scan once that one is too large to be alike.
    """
    order = np.argsort(sizes, kind="stable")
    sizes, signatures = sizes[order], signatures[order]
    _, top = np.unique(classes[order], return_inverse=True)
    floor, links = least_equal(percent), []
    left, offset = np.arange(len(order)), 0
    while (top != top[0]).any():
        offset += 1
        left = left[left + offset < len(order)]
        left = left[100 * sizes[left] >= percent * sizes[left + offset]]
        if not len(left):
            break
        a = left[top[left] != top[left + offset]]
        b = a + offset
        near = equal_groups(signatures[a], signatures[b]) >= floor
        for i, j in zip(a[near].tolist(), b[near].tolist()):
            if top[i] == top[j]:
                continue
            if sets is None or _alike(sets[order[i]], sets[order[j]], percent):
                links.append((int(order[i]), int(order[j])))
                top[top == top[j]] = top[i]
    return links


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal ``key`` in a sorted partition, one at a time."""
    held = []
    for batch in batches:
        keys = batch.column("key").to_numpy()
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for start, end in zip([0, *edges], [*edges, len(keys)]):
            if start == end:
                continue
            if held and held[0].column("key")[0].as_py() != keys[start]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _linker(percent: int, shingle: int | None):
    """Links within every run of rows of equal ``key``.

    With ``shingle`` the rows hold texts, whose sets decide.
    """

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            if len(group) < 2:
                continue
            nodes = group.column("node").to_numpy()
            # A set that came as a pivot may be in the part already.
            _, first = np.unique(nodes, return_index=True)
            group = group.take(pa.array(first))
            nodes = group.column("node").to_numpy()
            joined = b"".join(group.column("signature").to_pylist())
            signatures = np.frombuffer(joined, dtype=np.uint64).reshape(len(nodes), -1)
            sets = None
            if shingle is not None:
                sets = [shingle_set(text, shingle) for text in group.column("text").to_pylist()]
            links = spanning_links(
                group.column("n_shingles").to_numpy(),
                signatures,
                group.column("class").to_numpy(),
                percent,
                sets,
            )
            if links:
                ends = [pa.array(nodes[list(end)], pa.int64()) for end in zip(*links)]
                yield pa.RecordBatch.from_arrays(ends, ["u", "v"])

    return linked


def _links_by_key(
    rows: DataFrame, percent: int, shingle: int | None, partitions: int | None = None
) -> DataFrame:
    dealt = rows.repartition(partitions, "key") if partitions else rows.repartition("key")
    ordered = dealt.sortWithinPartitions("key")
    return ordered.mapInArrow(_linker(percent, shingle), "u long, v long")


def _clusters(sets: DataFrame, percent: int) -> DataFrame:
    """``node, cluster`` of all sets that an estimate joins with another one."""
    own = sets.select("node", F.explode("bands").alias("key"))
    sizes = own.groupBy("key").count().filter("count > 1")
    met = settle(own.join(sizes, "key"), "buckets")
    small = met.filter(F.col("count") <= CHUNK).select("key", "node")
    # Near copies share many bands, unlike texts with one common passage: each set of
    # a large bucket goes on by each of its other bands.
    large = met.filter(F.col("count") > CHUNK).select("key", "node")
    finer = large.join(sets.select("node", "bands"), "node").select(
        "node", "key", F.explode("bands").alias("other")
    )
    finer = finer.filter(F.col("key") < F.col("other")).select(
        F.xxhash64("key", "other").alias("key"), "node"
    )
    fine_sizes = finer.groupBy("key").count().filter("count > 1")
    fine = settle(finer.join(fine_sizes, "key"), "finer")
    hubs = fine.filter(F.col("count") > CHUNK)
    stars = hubs.join(hubs.groupBy("key").agg(F.min("node").alias("v")), "key")
    rows = small.unionByName(fine.filter(F.col("count") <= CHUNK).select("key", "node"))
    rows = rows.join(sets.select("node", "n_shingles", "signature"), "node")
    rows = rows.withColumn("class", F.col("node"))
    links = _links_by_key(rows, percent, None).unionByName(
        stars.filter(F.col("node") != F.col("v")).select(F.col("node").alias("u"), "v")
    )
    roots = components(settle(links, "met"))
    ends = roots.select("node", F.col("root").alias("cluster"))
    tops = roots.select(F.col("root").alias("node"), F.col("root").alias("cluster")).distinct()
    return settle(ends.unionByName(tops), "clusters")


def _true_links(members: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Links that span the true classes of every cluster.

    ``members``: ``node, cluster, n_shingles, signature, text``.
    """
    weights = members.groupBy("cluster").agg(
        F.ceil(F.sum("n_shingles") / PART_SHINGLES).alias("parts")
    )
    members = members.join(weights, "cluster").withColumn(
        "part", F.pmod(F.xxhash64(F.lit(SEED), "node"), F.col("parts"))
    )
    rows = members.withColumn("class", F.col("node"))
    shared = rows.filter((F.col("parts") > 1) & (F.col("part") < PIVOTS))
    pivots = shared.groupBy("cluster", "part").agg(F.min("node").alias("node"))
    pivots = rows.join(pivots.select("node"), "node", "left_semi")
    spread = pivots.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    columns = ["node", "n_shingles", "signature", "class", "text"]
    own = rows.unionByName(spread).select(F.xxhash64("cluster", "part").alias("key"), *columns)
    first = settle(_links_by_key(own, percent, shingle), "links")
    if rows.filter(F.col("parts") > 1).isEmpty():
        return first
    # Only clusters of several parts go on; classes known so far need no second look.
    roots = components(first).select("node", F.col("root").alias("known"))
    wide = rows.filter(F.col("parts") > 1).join(roots, "node", "left")
    wide = wide.withColumn("class", F.coalesce("known", "node")).drop("known")
    sizes = wide.groupBy("cluster", "class").count()
    main = sizes.groupBy("cluster").agg(F.max_by("class", F.struct("count", "class")).alias("main"))
    wide = settle(wide.join(main, "cluster"), "wide")
    rest = wide.filter(F.col("class") != F.col("main"))
    rest_parts = rest.groupBy("cluster").agg(
        F.ceil(F.sum("n_shingles") / PART_SHINGLES).alias("rests")
    )
    rest = rest.join(rest_parts, "cluster").withColumn(
        "rest", F.pmod(F.xxhash64(F.lit(SEED + 1), "node"), F.col("rests"))
    )
    to_all = rest.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    from_all = wide.join(rest_parts, "cluster").withColumn(
        "rest", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rests") - 1))
    )
    meeting = to_all.unionByName(from_all).select(
        F.xxhash64("cluster", "part", "rest").alias("key"), *columns
    )
    return first.unionByName(settle(_links_by_key(meeting, percent, shingle), "links"))


def _components(
    docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int
) -> tuple[DataFrame, DataFrame]:
    """Settled sketches of all rows, and ``set_key, root, component_id`` of all sets."""
    ship(docs.sparkSession)
    marked = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(text).alias("text_key"),
        F.inline(F.array(sketch(F.col(text), shingle))),
    )
    marked = settle(marked, "sketches")
    same = marked.filter("n_shingles > 0").groupBy("set_key").agg(
        F.min(F.struct("doc_id", "text_key")).alias("least"),
        F.min("doc_id").alias("first"),
        F.any_value("n_shingles").alias("n_shingles"),
        F.any_value("signature").alias("signature"),
        F.any_value("bands").alias("bands"),
    )
    sets = settle(same.withColumn("node", F.xxhash64("set_key")), "sets")
    clusters = _clusters(sets, percent)
    chosen = sets.join(clusters, "node").select(
        F.col("least.doc_id").alias("_id"),
        F.col("least.text_key").alias("_key"),
        "node",
        "cluster",
        "n_shingles",
        "signature",
    )
    texts = docs.select(
        F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_key"), F.col(text).alias("text")
    )
    found = texts.join(
        chosen, (texts._key == chosen._key) & texts._id.eqNullSafe(chosen._id)
    ).select("node", "cluster", "n_shingles", "signature", "text")
    members = settle(found.dropDuplicates(["node"]), "members")
    roots = components(settle(_true_links(members, percent, shingle), "links"))
    grouped = settle(
        sets.select("set_key", "first", "node")
        .join(roots, "node", "left")
        .select("set_key", "first", F.coalesce("root", "node").alias("root")),
        "grouped",
    )
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked, grouped.join(smallest, "root").select("set_key", "root", "component_id")


def jaccard_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    Documents are linked where their shingle sets have a similarity of ``percent``
    hundredths or more; of a component the document with the smallest id is kept.
    """
    marked, named = _components(docs, doc_id, text, shingle, percent)
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return marked.join(named, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def drop_jaccard_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
) -> DataFrame:
    """One document of every component, the one with the smallest id, as it was.

    Of several texts with that id one stays, with all its rows if it is repeated;
    rows without an id all stay, unless their component has a document with one.
    """
    marked, named = _components(docs, doc_id, text, shingle, percent)
    known = marked.join(named, "set_key").filter(F.col("component_id").isNotNull())
    first = (
        known.filter(F.col("doc_id") == F.col("component_id"))
        .groupBy("root")
        .agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    )
    lost = (
        known.join(first, "root")
        .filter(~F.struct("doc_id", "text_key").eqNullSafe(F.col("first")))
        .select(F.col("doc_id").alias("_lost"), F.col("text_key").alias("_lost_key"))
        .distinct()
    )
    lost = settle(lost, "lost")
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_key"))
    gone = F.col("_id").eqNullSafe(F.col("_lost")) & (F.col("_key") == F.col("_lost_key"))
    return rows.join(lost, gone, "left_anti").select("_row.*")
