"""Exact top-k inner products by block-max pruning.

Vectors are quantised to integers and ordered by their nearest of a few pivots, so
that neighbours are alike. A group is a run of ``GROUP`` vectors in this order,
made of blocks of ``BLOCK``. A block knows the largest and smallest value of each
component (its term maxima); summed with a query's weights they bound every score
in the block. For each query the blocks of a group are taken in the order of
these bounds and scored through their vectors, until no bound reaches the query's
k-th best score. Queries start with the k-th best score of the group that they
come from, so most groups are pruned from the first bound on.

Every query meets every group: queries travel in bundles to the groups, which are
streamed one at a time; a group is never repeated, a task holds one group and one
bundle. Each (bundle, group) returns at most k rows a query, and the best k of
those are taken at the end.

Defined cases: vectors that are null, or hold a null or non-finite component, and
rows without an id take no part. Rows that share an id are rows of their own: each
is a candidate, for the others as well, and where the id is a query's, each asks.
Shorter vectors are filled up with zeros. Components of any size are added exactly;
a score or component that no long holds becomes the nearest long. Groups of wide
vectors have fewer rows.
"""

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterloom.llm.ship import ship
from counterloom.shared import settle

TOP = 20
SCALE = 64
EVERY = 20
GROUP = 4096
GROUPS_PER_TASK = 4
BLOCK = 256
PIVOTS = 64
# Components of a group, and of all pivots.
GROUP_CELLS = 1 << 24
PIVOT_CELLS = 1 << 20
_NONE = -np.iinfo(np.int64).max  # its negative is still a long
_LEAST, _MOST = _NONE + 1, np.iinfo(np.int64).max
_EXACT = 2.0**53

_GROUP_ROW = (
    "ids binary, places binary, matrix binary,"
    " query_ids binary, query_places binary, queries binary, floors binary"
)


def integer_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, v``: valid vectors as whole numbers."""
    parts = F.transform(F.col(embedding), lambda x: x.cast("double"))
    broken = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), parts.alias("x"))
        .filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~broken)
        .select("vec_id", F.transform("x", lambda x: F.floor(x * SCALE)).alias("v"))
    )


def _matrix(vectors: pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=kind)
    sizes = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy()
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _nearest(pivots: np.ndarray) -> Column:
    """The pivot with the largest cosine, a rough order in which neighbours are alike."""
    norms = np.maximum(np.linalg.norm(pivots.astype(float), axis=1), 1.0)

    def nearest(vectors: pa.Array) -> pa.Array:
        scores = _matrix(vectors, pivots.shape[1]).astype(float) @ (pivots / norms[:, None]).T
        return pa.array(scores.argmax(axis=1).astype(np.int32))

    return F.arrow_udf(nearest, T.IntegerType())("v")


def _longs(values: np.ndarray) -> np.ndarray:
    """Whole numbers of any size as the nearest longs."""
    return np.clip(values, _LEAST, _MOST).astype(np.int64)


def _largest(values: np.ndarray) -> float:
    return float(np.abs(values.astype(np.float64)).max(initial=0))


def _plain_product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact products; by floating point where every sum is below 2**53.

    Where a sum may leave the longs, they are Python numbers.
    """
    most = _largest(left) * _largest(right) * left.shape[1]
    if most < _EXACT:
        return (left.astype(np.float64) @ right.astype(np.float64)).astype(np.int64)
    if most < float(_MOST) / 2:
        return left.astype(np.int64) @ right.astype(np.int64)
    return left.astype(object) @ right.astype(object)


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer products as longs."""
    return _longs(_plain_product(left, right))


def block_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """What no score of a query within the ranges of a block can exceed."""
    up = _plain_product(np.maximum(queries, 0), high.T)
    down = _plain_product(np.minimum(queries, 0), low.T)
    if up.dtype != object and down.dtype != object:
        return up + down
    return _longs(up.astype(object) + down.astype(object))


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k columns of each row by score, ties to the smaller id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    rows = np.arange(len(scores))[:, None]
    return scores[rows, order], ids[rows, order]


def pruned_search(
    queries: np.ndarray,
    query_ids: np.ndarray,
    floors: np.ndarray,
    matrix: np.ndarray,
    ids: np.ndarray,
    k: int = TOP,
    block: int = BLOCK,
    query_places: np.ndarray | None = None,
    places: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, int]:
    """Best scores and ids of each query in one group, and how many blocks were scored.

    ``floors``: a score that each query's k-th best is known to reach. A query does
    not meet the row of its own place; without places, ids tell rows apart. Results
    without a row hold the least long.
    """
    if places is None:
        query_places, places = query_ids, ids
    edges = np.arange(0, len(matrix), block)
    high = np.maximum.reduceat(matrix, edges, axis=0)
    low = np.minimum.reduceat(matrix, edges, axis=0)
    bounds = block_bounds(queries, low, high)
    order = np.argsort(-bounds, axis=1, kind="stable")
    best = np.full((len(queries), k), _NONE)
    names = np.full((len(queries), k), np.iinfo(np.int64).max)
    scored = 0
    for step in range(len(edges)):
        limits = np.maximum(floors, best[:, -1])
        chosen = order[:, step]
        live = np.flatnonzero(bounds[np.arange(len(queries)), chosen] >= limits)
        if not len(live):
            break
        for number in np.unique(chosen[live]):
            rows = live[chosen[live] == number]
            part = slice(edges[number], edges[number] + block)
            scores = product(queries[rows], matrix[part].T)
            scores[query_places[rows][:, None] == places[part][None]] = _NONE
            scored += len(rows)
            rise = scores.max(axis=1) >= limits[rows]
            rows, scores = rows[rise], scores[rise]
            if len(rows):
                both = np.concatenate([best[rows], scores], axis=1)
                owners = np.broadcast_to(ids[part], scores.shape)
                best[rows], names[rows] = _top(
                    both, np.concatenate([names[rows], owners], axis=1), k
                )
    return best, names, scored


def _groups(width: int, every: int, k: int, group: int, kind: type):
    """Ordered ``vec_id, place, v`` to groups, with the queries among their rows."""

    def pack(ids: np.ndarray, places: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
        asked = ids % every == 0
        none = np.full(int(asked.sum()), _NONE)
        asking = ids[asked], places[asked], matrix[asked]
        best, _, _ = pruned_search(
            asking[2], asking[0], none, matrix, ids, k, query_places=asking[1], places=places
        )
        parts = (ids, places, matrix, *asking, np.ascontiguousarray(best[:, -1]))
        arrays = [pa.array([part.tobytes()], pa.binary()) for part in parts]
        return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _GROUP_ROW.split(", ")])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, width), kind)]
        for batch in batches:
            new = batch["vec_id"].to_numpy(), batch["place"].to_numpy(), _matrix(batch["v"], width, kind)
            held = [np.concatenate(pair) for pair in zip(held, new)]
            while len(held[0]) >= group:
                yield pack(*[part[:group] for part in held])
                held = [part[group:] for part in held]
        if len(held[0]):
            yield pack(*held)

    return grouped


def _searched(width: int, k: int, kind: type):
    """Rows of a group, candidates first, then bundles of queries, to best rows."""

    def numbers(value: pa.Scalar, kind: type = np.int64) -> np.ndarray:
        return np.frombuffer(value.as_py(), dtype=kind)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = ids = places = None
        for batch in batches:
            for is_query, row_ids, row_places, rows, floors in zip(*batch.columns):
                own_ids, own_places = numbers(row_ids), numbers(row_places)
                own = numbers(rows, kind).reshape(len(own_ids), width)
                if not is_query.as_py():
                    matrix, ids, places = own, own_ids, own_places
                    continue
                best, names, _ = pruned_search(
                    own, own_ids, numbers(floors), matrix, ids, k, query_places=own_places, places=places
                )
                found = best != _NONE
                query, place = (
                    np.broadcast_to(x[:, None], best.shape)[found] for x in (own_ids, own_places)
                )
                columns = [pa.array(c) for c in (query, place, names[found], best[found])]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "place", "vec_id", "score"])

    return searched


def top_products(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    every: int = EVERY,
    k: int = TOP,
    group: int = GROUP,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of every row whose id ``every`` divides."""
    spark = vectors.sparkSession
    ship(spark)
    whole = integer_vectors(vectors, vec_id, embedding)
    # A place tells rows apart; in a settled table it stays what it is.
    whole = settle(whole.withColumn("place", F.monotonically_increasing_id()), "vectors")
    sizes = whole.agg(
        F.max(F.size("v")).alias("width"),
        F.max(F.greatest(F.abs(F.coalesce(F.array_max("v"), F.lit(0))), F.abs(F.coalesce(F.array_min("v"), F.lit(0))))).alias("peak"),
    ).first()
    width = sizes.width or 0
    kind = np.int32 if (sizes.peak or 0) < 1 << 31 else np.int64
    group = min(group, max(1, GROUP_CELLS // max(width, 1)))
    count = min(PIVOTS, max(1, PIVOT_CELLS // max(width, 1)))
    chosen = whole.orderBy(F.xxhash64("vec_id", "place"), "place").limit(count).collect()
    pivots = np.zeros((max(len(chosen), 1), width), dtype=np.int64)
    for row, vector in zip(pivots, chosen):
        row[: len(vector.v)] = vector.v
    # A few whole groups a partition, so that few groups are smaller than the others.
    tasks = max(1, ceil(whole.count() / (GROUPS_PER_TASK * group)))
    near = whole.withColumn("near", _nearest(pivots))
    ordered = near.repartitionByRange(tasks, "near", "vec_id", "place")
    ordered = ordered.sortWithinPartitions("near", "vec_id", "place").select("vec_id", "place", "v")
    groups = ordered.mapInArrow(_groups(width, every, k, group, kind), _GROUP_ROW)
    groups = settle(groups.withColumn("number", F.monotonically_increasing_id()), "groups")
    # A group's number is its partition's, shifted, plus its place there; what comes
    # to the driver is one count per partition.
    parts = groups.groupBy(F.shiftright("number", 33).alias("part")).count().collect()
    runs = [F.sequence(F.lit(p << 33), F.lit((p << 33) + n - 1)) for p, n in sorted(parts)]
    targets = F.flatten(F.array(*runs)) if runs else F.array().cast("array<bigint>")
    # Queries against all rows, by block: every bundle is sent to every group.
    sent = groups.filter(F.octet_length("query_ids") > 0).select(
        F.explode(targets).alias("target"),
        F.lit(True).alias("is_query"),
        F.col("query_ids").alias("ids"),
        F.col("query_places").alias("places"),
        F.col("queries").alias("rows"),
        "floors",
    )
    held = groups.select(
        F.col("number").alias("target"),
        F.lit(False).alias("is_query"),
        "ids",
        "places",
        F.col("matrix").alias("rows"),
        F.lit(b"").alias("floors"),
    )
    met = held.unionByName(sent).repartition("target")
    met = met.sortWithinPartitions("target", "is_query").drop("target")
    found = met.mapInArrow(
        _searched(width, k, kind), "query_id long, place long, vec_id long, score long"
    )
    best = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
