"""Packing token pieces into sequences by linear grouping and best fit.

Every document becomes pieces of at most ``capacity`` tokens; only longer
documents are cut. The packing is planned on the histogram of piece lengths, which
has at most ``capacity`` rows however large the corpus is, in whole runs of equal
sequences:

1. Lengths over ``capacity / SMALL`` are large. Sorted by length they are cut into
   ``GROUPS`` groups of equally many pieces and rounded up to the longest of their
   group, so only a few sizes remain.
2. For the largest size left, the configuration with it that fills a sequence best
   is found by dynamic programming over the sizes left, and used as often as the
   groups allow; and so on until no large piece is left.
3. The actual lengths take the places of the rounded ones, longest first.
4. Small pieces go, longest first, where they fit best: into the sequences with
   the least room that still hold them; new sequences open only when none does.

Pieces then take places by their rank among pieces of the same length. Ranks are
sums of counts per task plus the order within the task; no length, however
frequent, is gathered in one place.

Defined cases: a null text is empty and gives one piece, the end token alone.
Repeated rows are packed as often as they occur. Only the named columns are read.
"""

import json
import os
import re
import struct
import zlib
from functools import cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from counterloom.llm.bpe import byte_letters
from counterloom.llm.ship import ship
from counterloom.shared import settle

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CAPACITY = 4096
END = 1
GROUPS = 1024
SMALL = 8
KEPT_WORDS = 200_000
KEPT_PIECES = 150_000
_TEXTS = 64


class Run(NamedTuple):
    """``count`` sequences that hold pieces of the same ``lengths``, in this order."""

    lengths: tuple[int, ...]
    count: int


# Fixed values of the word-level format: its steps and how it cuts a text.
_STEPS = ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Words of these letters are in normal form, and the pattern has a short form for them.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class WordIds:
    """Ids of texts from a tokenizer file, remembering those of frequent words.

    The word-level format drops white space and never looks across it, so a text's
    ids are those of its words, and a plain word's those of its pieces. All ids come
    from the tokenizers library; a file of another format is given whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = [
            step
            for part, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))
            for step in (spec.get(part) or {}).get(inner, [])
        ]
        patterns = [s["pattern"].get("Regex") for s in steps if s["type"] == "Split"]
        self.by_word = [s["type"] for s in steps] == _STEPS and patterns == [_PATTERN]
        names = [re.escape(t["content"].encode()) for t in spec["added_tokens"]]
        self.special = re.compile(b"|".join(names) or b"(?!)")
        self.model = self.tokenizer.model
        self.letters = {byte: letter for letter, byte in byte_letters().items()}
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():  # visible ASCII letters stand for themselves
            letters = self.letters
            mapped = "".join([letters[byte] for byte in piece.encode()])
        else:
            mapped = piece
        ids = [token.id for token in self.model.tokenize(mapped)]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.pieces) < KEPT_PIECES:
            self.pieces[piece] = packed
        return packed

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if _PLAIN.fullmatch(text) and not self.special.search(word):
            get = self.pieces.get
            return b"".join([get(p) or self._piece(p) for p in _CUT.findall(text.lower())])
        return self._whole([text])[0]

    def pack(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        if not self.by_word:
            return self._whole([text.decode() for text in texts])
        known, out = self.known.get, []
        for text in texts:
            words = text.split()
            ids = [known(word) for word in words]
            if None in ids:
                for i, found in enumerate(ids):
                    if found is None:
                        ids[i] = self._word(words[i])
                        if len(self.known) < KEPT_WORDS:
                            self.known[words[i]] = ids[i]
            out.append(b"".join(ids))
        return out


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


_PIECE = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def cut_pieces(packed: bytes, capacity: int, end: int = END) -> list[tuple[int, int, int, int]]:
    """``piece, start, length, crc`` of a document's ids with the end token added."""
    data = packed + np.array([end], dtype="<u4").tobytes()
    out = []
    for number, at in enumerate(range(0, len(data), 4 * capacity)):
        part = data[at : at + 4 * capacity]
        out.append((number, at // 4, len(part) // 4, zlib.crc32(part)))
    return out


def _pieces(path: str, capacity: int):
    def cut(texts: pa.Array) -> pa.Array:
        rows, ends = [], [0]
        for first in range(0, len(texts), _TEXTS):
            some = [(t.as_py() or "").encode() for t in texts[first : first + _TEXTS]]
            for packed in word_ids(path).pack(some):
                rows += cut_pieces(packed, capacity)
                ends.append(len(rows))
        columns = zip(*rows) if rows else [[]] * 4
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds)]
        flat = pa.StructArray.from_arrays(arrays, _PIECE.names)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    return F.arrow_udf(cut, T.ArrayType(_PIECE))


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: every whole text, tokenized and cut."""
    ship(docs.sparkSession)
    pieces = _pieces(tokenizer, capacity)(F.col(text))
    return docs.select(F.col(doc_id).alias("doc_id"), F.inline(pieces))


def equal_groups(lengths: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count) in descending order, cut into groups of equally many pieces."""
    total = sum(count for _, count in lengths)
    size = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length, count in lengths:
        while count:
            if not room:
                out.append([])
                room = size
            take = min(room, count)
            out[-1].append((length, take))
            room, count = room - take, count - take
    return out


def best_configuration(sizes: list[int], counts: list[int], capacity: int) -> list[int]:
    """How often to use each size: the first size left at least once, room left least.

    ``sizes`` are descending. A set of reachable sums is one integer whose bits are
    shifted; sizes enter one by one, and the way back gives the configuration.
    """
    first = next(i for i, n in enumerate(counts) if n)
    room = capacity - sizes[first]
    limits = [min(n - (i == first), room // s) for i, (s, n) in enumerate(zip(sizes, counts))]
    mask = (1 << (room + 1)) - 1
    layers = [1]
    for size, limit in zip(sizes, limits):
        reach, shift, left = layers[-1], 1, limit
        while left:
            step = min(shift, left)
            reach |= (reach << (step * size)) & mask
            left -= step
            shift *= 2
        layers.append(reach)
    total = layers[-1].bit_length() - 1
    use = [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        while not layers[i] >> total & 1:
            use[i] += 1
            total -= sizes[i]
    use[first] += 1
    return use


def _substituted(use: list[int], times: int, stock: list[list[list[int]]]) -> list[Run]:
    """Runs of a configuration with actual lengths, taken longest first from each group."""
    places = [group for group, n in enumerate(use) for _ in range(n)]
    queues = []
    for group in places:
        queue, need = [], times
        while need:
            length, count = stock[group][0]
            take = min(need, count)
            queue.append([length, take])
            stock[group][0][1] -= take
            need -= take
            if not stock[group][0][1]:
                stock[group].pop(0)
        queues.append(queue)
    runs = []
    while queues[0]:
        count = min(queue[0][1] for queue in queues)
        runs.append(Run(tuple(queue[0][0] for queue in queues), count))
        for queue in queues:
            queue[0][1] -= count
            if not queue[0][1]:
                queue.pop(0)
    return runs


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Run]:
    """Runs of sequences that hold exactly the pieces of ``histogram`` (length: count)."""
    lengths = sorted(((n, c) for n, c in histogram.items() if c), reverse=True)
    large = [(n, c) for n, c in lengths if n > capacity // SMALL and n < capacity]
    stock = [[list(pair) for pair in group] for group in equal_groups(large, groups)]
    sizes = [group[0][0] for group in stock]
    left = [sum(count for _, count in group) for group in stock]
    runs = [Run((n,), c) for n, c in lengths if n == capacity]
    while any(left):
        use = best_configuration(sizes, left, capacity)
        times = min(n // u for n, u in zip(left, use) if u)
        runs += _substituted(use, times, stock)
        left = [n - u * times for n, u in zip(left, use)]
    return fill_small(runs, [(n, c) for n, c in lengths if n <= capacity // SMALL], capacity)


def fill_small(runs: list[Run], small: list[tuple[int, int]], capacity: int) -> list[Run]:
    """Best fit of small pieces, longest first, into runs of sequences and new ones."""
    by_room: list[list[Run]] = [[] for _ in range(capacity + 1)]
    for run in runs:
        by_room[capacity - sum(run.lengths)].append(run)
    for length, count in small:
        for room in range(length, capacity + 1):
            each, waiting = room // length, by_room[room]
            while waiting and count:
                run = waiting.pop()
                full = min(run.count, count // each)
                if not full:
                    rest, full = count, 1
                else:
                    rest = each
                count -= rest * full
                changed = Run(run.lengths + (length,) * rest, full)
                by_room[room - rest * length].append(changed)
                if run.count > full:
                    waiting.append(Run(run.lengths, run.count - full))
            if not count:
                break
        each = capacity // length
        for pieces, times in ((each, count // each), (count % each, 1)):
            if pieces and times:
                by_room[capacity - pieces * length].append(Run((length,) * pieces, times))
    return [run for waiting in by_room for run in waiting]


class Places(NamedTuple):
    """Places of pieces by length and rank: key ranges, first sequence, offset."""

    keys: np.ndarray
    sequences: np.ndarray
    offsets: np.ndarray


_RANK_BITS = 48


def places(runs: list[Run]) -> Places:
    """Every run gives each of its lengths one range of ranks."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for run in runs:
        for length, end in zip(run.lengths, accumulate(run.lengths)):
            rank = taken.get(length, 0)
            rows.append(((length << _RANK_BITS) + rank, sequence, end - length))
            taken[length] = rank + run.count
        sequence += run.count
    columns = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
    return Places(columns[:, 0], columns[:, 1], columns[:, 2])


_PLACE = T.StructType(
    [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
)


def _placed(table: Places) -> Column:
    def find(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        keys = (lengths.to_numpy() << _RANK_BITS) + ranks.to_numpy()
        at = np.searchsorted(table.keys, keys, side="right") - 1
        sequence = table.sequences[at] + (keys - table.keys[at])
        return pa.StructArray.from_arrays(
            [pa.array(sequence), pa.array(table.offsets[at])], _PLACE.names
        )

    return F.arrow_udf(find, _PLACE).asNondeterministic()(F.col("length"), F.col("rank"))


def pack_pieces(
    pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS
) -> DataFrame:
    """``pieces`` (any columns, ``doc_id, piece, length`` among them) with their places."""
    ship(pieces.sparkSession)
    stored = settle(pieces.withColumn("part", F.spark_partition_id()), "pieces")
    counts = settle(stored.groupBy("part", "length").count(), "piece-counts")
    # At most one row per length up to the capacity.
    totals = counts.groupBy("length").agg(F.sum("count").alias("n")).collect()
    table = places(plan({row.length: row.n for row in totals}, capacity, groups))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    base = counts.select(
        "part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("part", "length").orderBy("doc_id", "piece")
    ranked = stored.withColumn("place", F.row_number().over(within) - 1)
    # Bases grow with the tasks, and the pieces already lie by part and length.
    ranked = ranked.join(base.hint("merge"), ["part", "length"])
    ranked = ranked.withColumn("rank", (F.col("base") + F.col("place")).cast("long"))
    return ranked.withColumn("p", _placed(table)).select(
        *pieces.columns, "p.sequence_id", "p.offset"
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    groups: int = GROUPS,
) -> DataFrame:
    """All documents as pieces with ``sequence_id`` and ``offset``."""
    return pack_pieces(token_pieces(docs, tokenizer, doc_id, text, capacity), capacity, groups)
