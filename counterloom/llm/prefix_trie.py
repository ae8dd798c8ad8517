"""A trie of conversations by their turns, built from fixed-length blocks.

Turns are hashed, and blocks of ``BLOCK`` turns by the hashes of their turns, blocks
of ``FAN`` blocks by the hashes of those, until one block holds the longest
conversation. The identity of a prefix is then found from the top down: a block
starts with the identity of all blocks before it, so equal prefixes of any two
conversations have equal identities, a task never sees more than one block, and the
number of passes grows with the logarithm of the longest conversation.

Conversations are grouped by the identity at the start of a block and the digest of
the block itself first. Where all that go on from a prefix go on with the same
block, its inner boundaries have the members of the block and are read off it.
Only where siblings diverge are the boundaries inside the blocks told apart.

Every node is named by its smallest member and its depth. Sums over subtrees are
taken by doubling: after round j a node holds the sum over its descendants up to
``2^j - 1`` levels below, and the ancestor ``2^j`` levels up is looked up on the path
of the node's own smallest member, by a key that no two nodes share.

Digests are MD5 over texts with their lengths. The hash over the members that end at
a node reads them in order, in pieces of bounded size.

Defined cases: null roles and texts are empty; turns of equal number follow in the
order of role and text, repeated ones stay. A negative conversation number keeps the
sign of its remainder. Rows without a conversation number belong to no
conversation and are left out. An empty table has no node. Only the named columns
are read.
"""

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterloom.llm.hilbert import running_sums
from counterloom.llm.ship import ship
from counterloom.shared import settle

BLOCK = 4
FAN = 16
SHARE = 5
HEADS = 9
PIECE = 4096
_ROOT = "0" * 32


def hashed_turns(turns: DataFrame) -> DataFrame:
    """``conv, pos, digest, bytes``: the size of the text and a digest of role and text."""
    size = F.length("role").cast("string")
    digest = F.md5(F.concat(size, F.lit(":"), "role", F.lit(":"), "text").cast("binary"))
    size = F.octet_length("text").cast("long")
    return turns.select("conv", "pos", digest.alias("digest"), size.alias("bytes"))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv, pos, role, text``: the turns of every conversation, numbered from 1.

    Numbers come from sums over range partitions, so no conversation has to fit one
    task.
    """
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(1).cast("long").alias("_one"),
    )
    placed = running_sums(turns, ["conv", "turn", "role", "text"], ["_one"])
    firsts = placed.groupBy("conv").agg(F.min("_before__one").alias("first"))
    return placed.join(firsts, "conv").select(
        "conv", (F.col("_before__one") - F.col("first") + 1).alias("pos"), "role", "text"
    )


def shared_heads(turns: DataFrame) -> DataFrame:
    """Every conversation c behind the first turns of conversation ``c - c % SHARE``.

    The first ``crc32(c) % HEADS`` turns of that conversation take the place of as
    many turns of c.
    """
    number = F.col("conv")
    own = turns.groupBy("conv").agg(F.count("*").alias("own_turns")).select(
        "conv",
        (number - number % SHARE).alias("base"),
        (F.crc32(number.cast("string").cast("binary")) % HEADS).alias("h"),
    )
    own = settle(own, "conversations")
    # At most HEADS - 1 turns of each base.
    heads = turns.filter(F.col("pos") < HEADS).withColumnRenamed("conv", "base")
    borrowed = own.join(heads, "base").filter(F.col("pos") <= F.col("h"))
    lengths = heads.groupBy("base").agg(F.count("*").alias("n"))
    shift = F.least("h", F.coalesce("n", F.lit(0))) - F.col("h")
    shifts = own.join(lengths, "base", "left").select("conv", "h", shift.alias("shift"))
    rest = turns.join(shifts, "conv").filter(F.col("pos") > F.col("h"))
    columns = turns.columns
    moved = rest.withColumn("pos", F.col("pos") + F.col("shift"))
    return borrowed.select(columns).unionByName(moved.select(columns))


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat(*parts).cast("binary"))


def _chained(start: Column, digests: Column) -> Column:
    """Identities after each of the digests, beginning at ``start``; a few items."""
    step = F.aggregate(
        digests,
        F.array(start),
        lambda seen, digest: F.concat(seen, F.array(_digest(F.element_at(seen, -1), digest))),
    )
    return F.slice(step, 2, F.size(digests))


def _grouped(items: DataFrame, fan: int) -> DataFrame:
    """Runs of ``fan`` items of a conversation: ``conv, place, digests, digest``."""
    blocks = items.groupBy("conv", F.expr(f"place div {fan}").alias("block")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda i: i.digest
        ).alias("digests")
    )
    return blocks.select(
        "conv",
        F.col("block").alias("place"),
        "digests",
        F.md5(F.array_join("digests", "").cast("binary")).alias("digest"),
    )


def block_starts(turns: DataFrame) -> DataFrame:
    """``conv, place, start, digest, digests``: every block with its prefix before it.

    ``turns``: a settled table with ``conv, pos, digest``.
    """
    items = turns.select("conv", (F.col("pos") - 1).alias("place"), "digest")
    levels = [settle(_grouped(items, BLOCK), "blocks")]
    while levels[-1].agg(F.max("place")).first()[0]:
        levels.append(settle(_grouped(levels[-1].select("conv", "place", "digest"), FAN), "blocks"))
    starts = levels[-1].select("conv", "place", F.lit(_ROOT).alias("start"))
    for upper in levels[:0:-1]:
        # The items of an upper block are the blocks below it, in order.
        known = F.col("start")
        befores = F.concat(F.array(known), _chained(known, F.slice("digests", 1, F.size("digests") - 1)))
        below = upper.join(starts, ["conv", "place"]).select(
            "conv", "place", F.posexplode(befores).alias("i", "start")
        )
        below = below.select("conv", (F.col("place") * FAN + F.col("i")).alias("place"), "start")
        starts = settle(below, "starts")
    return levels[0].join(starts, ["conv", "place"])


def paths(turns: DataFrame) -> DataFrame:
    """``conv, depth, node``: the smallest member of every prefix of every conversation.

    ``turns``: a settled table with ``conv, pos, digest``.
    """
    blocks = settle(block_starts(turns), "blocks")
    ways = blocks.groupBy("start").agg(
        F.min("conv").alias("least"),
        (F.min("digest") == F.max("digest")).alias("alike"),
    )
    met = settle(blocks.join(ways, "start"), "met")
    place = F.col("place") * BLOCK
    depths = F.sequence(place + 1, place + F.size("digests"))
    alike = met.filter("alike").select("conv", F.explode(depths).alias("depth"), F.col("least").alias("node"))
    marked = F.arrays_zip(depths.alias("depth"), _chained(F.col("start"), F.col("digests")).alias("mark"))
    apart = settle(met.filter(~F.col("alike")).select("conv", F.inline(marked)), "apart")
    firsts = apart.groupBy("depth", "mark").agg(F.min("conv").alias("node"))
    told = apart.join(firsts, ["depth", "mark"]).select("conv", "depth", "node")
    return alike.unionByName(told)


def _sha_of_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash over the pieces of each node; pieces come sorted."""
    key, state = None, None

    def done():
        node, depth = key
        columns = [pa.array([node]), pa.array([depth]), pa.array([state.hexdigest()])]
        return pa.RecordBatch.from_arrays(columns, ["node", "depth", "ends_sha256"])

    for batch in batches:
        for node, depth, piece in zip(
            *[batch.column(c).to_pylist() for c in ("node", "depth", "piece")]
        ):
            if key != (node, depth):
                if key is not None:
                    yield done()
                key, state = (node, depth), hashlib.sha256(piece.encode())
            else:
                state.update(f",{piece}".encode())
    if key is not None:
        yield done()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted members joined into pieces of at most ``PIECE`` of one node."""

    def row(key, members):
        columns = [pa.array([key[0]]), pa.array([key[1]]), pa.array([members[0]])]
        columns.append(pa.array([",".join(map(str, members))]))
        return pa.RecordBatch.from_arrays(columns, ["node", "depth", "least", "piece"])

    key, members = None, []
    for batch in batches:
        for node, depth, conv in zip(*[batch.column(c).to_pylist() for c in ("node", "depth", "conv")]):
            if members and (key != (node, depth) or len(members) == PIECE):
                yield row(key, members)
                members = []
            key = (node, depth)
            members.append(conv)
    if members:
        yield row(key, members)


def ends_hash(ends: DataFrame) -> DataFrame:
    """``node, depth, ends_sha256`` over the members (``conv``) that end at each node."""
    order = ["node", "depth", "conv"]
    ranged = ends.select(order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = ranged.mapInArrow(_pieces, "node long, depth long, least long, piece string")
    dealt = pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "least")
    return dealt.mapInArrow(_sha_of_sorted, "node long, depth long, ends_sha256 string")


def _subtree_sums(nodes: DataFrame, path: DataFrame, columns: list[str], deepest: int) -> DataFrame:
    """``node, depth`` and the sums of the columns over each subtree."""
    held = nodes.select("node", "depth", *columns)
    for step in accumulate([1] * deepest, lambda a, _: 2 * a):
        if step > deepest:
            break
        above = path.select(
            F.col("conv").alias("node"), (F.col("depth") + step).alias("depth"), F.col("node").alias("up")
        )
        sent = held.join(above, ["node", "depth"]).groupBy(
            F.col("up").alias("node"), (F.col("depth") - step).alias("depth")
        ).agg(*[F.sum(c).alias(f"_{c}") for c in columns])
        held = settle(
            held.join(sent, ["node", "depth"], "left").select(
                "node", "depth", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in columns]
            ),
            "sums",
        )
    return held


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """All nodes of the trie of conversations.

    ``turns``: ``conv, pos, role, text`` with gapless ``pos`` from 1; ``members``:
    ``conv`` of all conversations, those without a turn included.
    """
    return hashed_trie(hashed_turns(turns), members)


def hashed_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """``prefix_trie`` of turns that are hashed already."""
    ship(turns.sparkSession)
    hashed = settle(turns, "hashed")
    members = settle(members, "members")
    least = members.agg(F.min("conv")).first()[0]
    roots = members.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(least).cast("long").alias("node"))
    path = settle(paths(hashed.select("conv", "pos", "digest")).unionByName(roots), "paths")
    deepest = path.agg(F.max("depth")).first()[0] or 0
    counts = path.groupBy("node", "depth").agg(F.count("*").alias("n_convs"))
    own = hashed.select(F.col("conv").alias("node"), F.col("pos").alias("depth"), "bytes")
    parents = path.select(
        F.col("conv").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent")
    )
    nodes = counts.join(own, ["node", "depth"], "left").join(parents, ["node", "depth"], "left")
    nodes = settle(nodes, "nodes")
    children = (
        nodes.filter("depth > 0")
        .groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth"))
        .agg(F.count("*").alias("n_children"))
    )
    saved = (F.col("n_convs") - 1) * F.coalesce("bytes", F.lit(0))
    counted = settle(
        nodes.join(children, ["node", "depth"], "left").select(
            "node",
            "depth",
            "parent",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.col("n_children").isNull().cast("long").alias("n_leaves"),
            saved.alias("saved_tokens"),
        ),
        "counted",
    )
    sums = _subtree_sums(counted, path, ["n_leaves", "saved_tokens"], deepest)
    last = path.groupBy("conv").agg(F.max("depth").alias("depth"))
    ends = ends_hash(path.join(last, ["conv", "depth"]))
    named = (
        counted.drop("n_leaves", "saved_tokens")
        .join(sums, ["node", "depth"])
        .join(ends, ["node", "depth"], "left")
    )
    return named.select(
        F.col("node").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations behind their shared heads."""
    turns = settle(hashed_turns(ordered_turns(conversations)), "ordered")
    return hashed_trie(shared_heads(turns), turns.select("conv").distinct())
