"""Removal of passages that earlier documents hold, by prefix-partitioned suffix trees.

A repeat is a window of ``WINDOW`` consecutive words. A suffix is read in letters
of ``LETTER`` words (a 32-bit hash each), as deep as a window: five letters. Two
suffixes that share a path of five letters share the window.

1. Each document gives sparse anchors: of every run of word groups that a window
   covers, the one with the least hash. A window that occurs in two documents has
   the same anchor in both, so only suffixes whose anchor is known from another
   document can be repeated. Copies of a whole text are found by its digest and
   stay out of what follows.
2. The remaining suffixes are split by prefix. A prefix starts with one letter and
   grows by one wherever more than ``group`` suffixes still share it, so groups
   fit in memory; tasks take whole groups. A prefix that is a full window and
   still too frequent needs no tree: it is one node, and the smallest document
   of the node is an ordinary aggregate.
3. A task sorts its suffixes; adjacent common prefixes give the internal nodes of
   the subtrees. A node as deep as a window is a maximal repeat's window: it
   concerns every suffix below it whose document is not the smallest there.
4. Positions go back to the documents, overlapping windows join to passages, and
   the words covered by them go.

Defined cases: a null text has no words. Documents under ``WINDOW`` words are left
as they are. Repeated rows with one id never remove from each other. A null id
counts as larger than every id. Only the named columns are read.
"""

import hashlib
from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterloom.llm.ship import ship
from counterloom.llm.text import WORD_GAPS
from counterloom.shared import discard, settle

WINDOW = 50
LETTER = 10
DEPTH = WINDOW // LETTER
GROUP = 50_000
TASK_SUFFIXES = 500_000
LAST = 2**63 - 1

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_CHUNK = 1 << 18
_IS_GAP = np.isin(np.arange(256), list(WORD_GAPS))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scatter all bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count, base % 2**64, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_BYTE_CODES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_UP = _powers(_BASE, 2 * _CHUNK)
_DOWN = _powers(pow(_BASE, -1, 2**64), 2 * _CHUNK)


def _chunk_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word of one chunk, from sums of powers over its bytes."""
    octets = np.frombuffer(data, dtype=np.uint8)
    gap = np.concatenate([[True], _IS_GAP[octets], [True]])
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    ends = np.flatnonzero(~gap[:-1] & gap[1:])
    if len(octets) <= len(_UP):
        up, down = _UP[: len(octets)], _DOWN[: len(octets)]
    else:
        up = _powers(_BASE, len(octets))
        down = _powers(pow(_BASE, -1, 2**64), len(octets))
    sums = np.zeros(len(octets) + 1, dtype=np.uint64)
    np.add.accumulate(_BYTE_CODES[octets] * up, out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of all words of a text, chunk by chunk, cut at gaps between words."""
    parts, at = [], 0
    while at < len(data):
        end = at + _CHUNK
        if end < len(data):
            gaps = _IS_GAP[np.frombuffer(data, np.uint8, _CHUNK, at)]
            back = int(np.argmax(gaps[::-1]))
            while not gaps.any() and end < len(data) and data[end] not in WORD_GAPS:
                end += 1
            end -= back if gaps.any() else 0
        parts.append(_chunk_hashes(data[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)


def letter_hashes(words: np.ndarray) -> np.ndarray:
    """The letter that starts at every word: a hash of ``LETTER`` words."""
    count = max(0, len(words) - LETTER + 1)
    total = np.zeros(count, dtype=np.uint64)
    for i in range(LETTER):
        total = total * np.uint64(_BASE) + words[i : i + count]
    return _mixed(total)


def window_anchors(letters: np.ndarray) -> np.ndarray:
    """Position of the anchor of every window: the first least letter within it."""
    inside = WINDOW - LETTER + 1
    if len(letters) < inside:
        return np.empty(0, dtype=np.int64)
    parts = []
    for at in range(0, len(letters) - inside + 1, _CHUNK):
        piece = letters[at : at + _CHUNK + inside - 1]
        runs = np.lib.stride_tricks.sliding_window_view(piece, inside)
        parts.append(runs.argmin(axis=1) + np.arange(at, at + len(runs)))
    return np.concatenate(parts)


def _digest(data: bytes) -> str:
    return hashlib.sha256(b" ".join(data.split())).hexdigest()


_OUTLINE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("digest", T.StringType()),
        T.StructField("anchors", T.ArrayType(T.LongType())),
    ]
)


def _outlines(texts: pa.Array) -> pa.Array:
    counts, digests, anchors, ends = [], [], [], [0]
    for value in texts:
        data = (value.as_py() or "").encode()
        letters = letter_hashes(word_hashes(data))
        counts.append(len(data.split()))
        digests.append(_digest(data))
        anchors.append(np.unique(letters[np.unique(window_anchors(letters))]).view(np.int64))
        ends.append(ends[-1] + len(anchors[-1]))
    lists = pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()), pa.array(np.concatenate([*anchors, np.empty(0, np.int64)]))
    )
    return pa.StructArray.from_arrays(
        [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), lists],
        names=["n_words", "digest", "anchors"],
    )


def _outline(text: Column) -> Column:
    return F.arrow_udf(_outlines, _OUTLINE).asNondeterministic()(text)


_SUFFIXES = "doc long, row long, pos int, head long, mid long, tail long"
_BATCH = 200_000


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes of ``doc, row, text, shared`` whose anchor is shared; letters packed by two."""

    def packed(parts: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(np.concatenate(c)) for c in zip(*parts)]
        return pa.RecordBatch.from_arrays(columns, ["doc", "row", "pos", "head", "mid", "tail"])

    parts, held = [], 0
    for batch in batches:
        for doc, row, text, shared in zip(*batch.columns):
            letters = letter_hashes(word_hashes(text.as_py().encode()))
            wanted = np.sort(shared.values.to_numpy().view(np.uint64))
            found = letters[window_anchors(letters)]
            spot = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
            at = np.flatnonzero(wanted[spot] == found)
            short = (letters >> np.uint64(32)).astype(np.int64)
            path = [short[at + i * LETTER] for i in range(DEPTH)]
            owner = [np.full(len(at), x.as_py(), dtype=np.int64) for x in (doc, row)]
            pairs = [(path[0] << 32) | path[1], (path[2] << 32) | path[3], path[4]]
            parts.append((*owner, at.astype(np.int32), *pairs))
            held += len(at)
            if held >= _BATCH:
                yield packed(parts)
                parts, held = [], 0
    if parts:
        yield packed(parts)


def _prefix(depth: int) -> Column:
    """The first ``depth`` letters of a suffix as one key."""
    parts = [F.shiftright("head", 32), F.col("head"), F.shiftright("mid", 32), F.col("mid")]
    keys = [[parts[0]], [parts[1]], [parts[1], parts[2]], [parts[1], parts[3]]]
    keys.append([parts[1], parts[3], F.col("tail")])
    return F.xxhash64(F.lit(depth), *keys[depth - 1])


def deep_nodes(columns: dict[str, np.ndarray]) -> np.ndarray:
    """Which suffixes hang below a window-deep node with a smaller document.

    The suffixes are sorted along their letters; where two neighbours share all of
    them, they belong to one node.
    """
    order = np.lexsort((columns["tail"], columns["mid"], columns["head"]))
    if not len(order):
        return order
    path = [columns[name][order] for name in ("head", "mid", "tail")]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in path])
    doc = columns["doc"][order]
    first = np.minimum.reduceat(doc, np.flatnonzero(new))
    return order[first[np.cumsum(new) - 1] < doc]


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = list(batches)
    if parts:
        table = pa.Table.from_batches(parts)
        columns = {name: table[name].to_numpy() for name in table.column_names}
        at = deep_nodes(columns)
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns["row"][at]), pa.array(columns["pos"][at])], names=["row", "pos"]
        )


def _heavy(keyed: DataFrame, group: int) -> DataFrame:
    """Keys of more than ``group`` suffixes."""
    counts = keyed.groupBy("key").count().filter(F.col("count") > group)
    return settle(counts.select("key"), "prefixes")


def repeated_suffixes(suffixes: DataFrame, tasks: int, group: int = GROUP) -> DataFrame:
    """``row, pos`` of all suffixes whose window also starts in a smaller document.

    ``tasks``: over how many tasks the groups are dealt.
    """
    columns = ["doc", "row", "pos", "head", "mid", "tail"]
    keyed = suffixes.withColumn("key", _prefix(1))
    heavy = _heavy(keyed, group)
    # Only suffixes below a frequent letter are looked at again, letter by letter.
    deep = settle(keyed.join(heavy, "key", "left_semi"), "deep-suffixes")
    parts = [keyed.join(heavy, "key", "left_anti")]
    for depth in range(2, DEPTH + 1):
        deep = deep.withColumn("key", _prefix(depth))
        heavy = _heavy(deep, group)
        parts.append(deep.join(heavy, "key", "left_anti"))
        deep = deep.join(heavy, "key", "left_semi")
    # What is left are whole windows: nodes of their own.
    firsts = deep.groupBy("head", "mid", "tail").agg(F.min("doc").alias("first"))
    frequent = (
        deep.join(firsts, ["head", "mid", "tail"])
        .filter(F.col("first") < F.col("doc"))
        .select("row", "pos")
    )
    grouped = reduce(DataFrame.unionByName, [part.select("key", *columns) for part in parts])
    trees = grouped.repartition(tasks, "key").select(*columns)
    trees = trees.mapInArrow(_repeats, "row long, pos int")
    return trees.unionByName(frequent)


_KEPT = T.StructType(
    [
        T.StructField("n_removed", T.LongType()),
        T.StructField("rest_digest", T.StringType()),
        T.StructField("rest", T.StringType()),
    ]
)


def removed_words(count: int, positions: np.ndarray) -> np.ndarray:
    """Which of ``count`` words a window starting at one of ``positions`` covers."""
    change = np.zeros(count + 1, dtype=np.int64)
    np.add.at(change, positions, 1)
    np.add.at(change, positions + WINDOW, -1)
    return np.cumsum(change[:count]) > 0


def without_words(data: bytes, gone: np.ndarray) -> bytes:
    """The text without the marked words and the gap after each."""
    octets = np.frombuffer(data, dtype=np.uint8)
    gap = np.concatenate([[True], _IS_GAP[octets]])
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    sizes = np.diff(np.concatenate([starts, [len(octets)]]))
    keep = np.concatenate([np.ones(starts[0], dtype=bool), np.repeat(~gone, sizes)])
    return octets[keep].tobytes()


def _cuts(texts: pa.Array, positions: pa.Array) -> pa.Array:
    counts, digests, rests = [], [], []
    for text, starts in zip(texts, positions):
        data = text.as_py().encode()
        count = len(data.split())
        gone = removed_words(count, starts.values.to_numpy().astype(np.int64))
        rest = without_words(data, gone)
        counts.append(int(gone.sum()))
        digests.append(_digest(rest))
        rests.append(rest.decode())
    columns = [pa.array(counts, pa.int64()), pa.array(digests, pa.string())]
    return pa.StructArray.from_arrays([*columns, pa.array(rests, pa.string())], _KEPT.names)


def _cut(text: Column, positions: Column) -> Column:
    return F.arrow_udf(_cuts, _KEPT).asNondeterministic()(text, positions)


def _known_id(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc, key, text``: rows with one id may hold different texts."""
    return docs.select(
        _known_id(doc_id).alias("doc"), F.xxhash64(text).alias("key"), F.col(text).alias("text")
    )


def repeated_passages(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    group: int = GROUP,
    task_suffixes: int = TASK_SUFFIXES,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What every document loses, as three settled tables.

    ``outlines`` (doc, key, n_words, digest: one row per document), ``copies``
    (digest, first: smallest document of each text that several documents have)
    and ``cut`` (doc, key, n_removed, rest_digest, rest: documents that lose a part).
    """
    spark = docs.sparkSession
    ship(spark)
    named = _named(docs, doc_id, text)
    outlined = named.select("doc", "key", _outline(F.col("text")).alias("o"))
    outlines = settle(outlined.select("doc", "key", "o.*"), "outlines")
    firsts = outlines.groupBy("digest").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"))
    firsts = settle(firsts, "firsts")
    single = outlines.join(firsts, ["digest", "doc"], "left_semi")
    anchors = single.select("doc", "key", "n_words", F.explode("anchors").alias("anchor"))
    spread = anchors.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b"))
    shared = spread.filter(F.col("a") < F.col("b")).select("anchor")
    suspects = (
        anchors.join(shared, "anchor", "left_semi")
        .groupBy("doc", "key")
        .agg(F.collect_set("anchor").alias("shared"), F.max("n_words").alias("n_words"))
    )
    texts = named.join(suspects, ["doc", "key"])
    texts = settle(texts.withColumn("row", F.monotonically_increasing_id()), "suspects")
    most = texts.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first().n
    tasks = max(ceil(most / task_suffixes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    suffixes = texts.select("doc", "row", "text", "shared").mapInArrow(_suffixes, _SUFFIXES)
    found = repeated_suffixes(suffixes, tasks, group)
    starts = found.groupBy("row").agg(F.collect_list("pos").alias("starts"))
    cut = (
        texts.select("row", "doc", "key", "text")
        .join(starts, "row")
        .select("doc", "key", _cut(F.col("text"), F.col("starts")).alias("k"))
        .select("doc", "key", "k.*")
    )
    cut = settle(cut.dropDuplicates(["doc", "key"]), "cut")
    discard(texts)
    copies = firsts.filter(F.col("doc") < F.col("last"))
    return outlines.drop("anchors"), copies.select("digest", F.col("doc").alias("first")), cut


def _is_copy() -> Column:
    return (F.col("first") < F.col("doc")) & (F.col("n_words") >= WINDOW)


def passage_digests(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    group: int = GROUP,
    task_suffixes: int = TASK_SUFFIXES,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    outlines, copies, cut = repeated_passages(docs, doc_id, text, group, task_suffixes)
    return (
        outlines.join(copies, "digest", "left")
        .join(cut.drop("rest"), ["doc", "key"], "left")
        .select(
            F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"),
            "n_words",
            F.when(_is_copy(), F.col("n_words"))
            .otherwise(F.coalesce("n_removed", F.lit(0)))
            .alias("n_removed"),
            F.when(_is_copy(), F.sha2(F.lit("").cast("binary"), 256))
            .otherwise(F.coalesce("rest_digest", "digest"))
            .alias("kept_sha256"),
        )
    )


def remove_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with repeated passages cut out of their text; all rows and columns stay."""
    outlines, copies, cut = repeated_passages(docs, doc_id, text)
    copied = outlines.join(copies, "digest").filter(_is_copy())
    copied = copied.select("doc", "key", F.lit("").alias("rest")).distinct()
    changed = cut.select("doc", "key", "rest").unionByName(copied)
    changed = changed.withColumn("changed", F.lit(True))
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    rows = docs.select(row, _known_id(doc_id).alias("doc"), F.xxhash64(text).alias("key"))
    new = F.when(F.col("changed"), F.col("rest")).otherwise(F.col(f"row.`{text}`"))
    return rows.join(changed, ["doc", "key"], "left").select(
        *[(new if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    )
