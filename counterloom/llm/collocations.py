"""Collocations by weighted acyclic automata.

A ``CountAutomaton`` maps phrases of one to three labels to their counts. It is built
from sorted phrases, from its last arcs to its first: a state is finished once the
next prefix begins, and finished states with equal arcs and weights are shared. It
has one arc for each phrase, so the weight of a path is the count of the phrase
that ends there, and longer phrases share the arcs of their prefixes. All steps work
on whole arrays.

Every task counts the phrases of its texts in batches of bounded size, builds one
automaton for each batch, language and range of prefixes, and sends it to where all
automata of that range meet. There they are united range by range: equal phrases
meet in sorted order and their weights are added. Only phrases that reach the
smallest count leave; a phrase cannot be more frequent than its parts, so every
part of such a phrase leaves as well.

The parts of candidates are looked up by composition: requests for parts travel to
the range of the part, where an automaton of the phrases of that range answers
them. Popular parts are copied to a few ranges and requests choose one by the hash
of their phrase.

Words are labelled by 64-bit hashes; their spelling comes back by a join at the end.
Scores are quotients of whole numbers of up to 38 digits.

Defined cases: a null text is empty, a null language is ``und``. A text of any
length is read in slices; phrases reach across slices and batches. Repeated rows
count as often as they occur. An empty table has no collocation. Only the named
columns are read.
"""

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterloom.llm.ship import ship
from counterloom.shared import settle

SEED = 42
LEAST = 10
SHARE = 50
TOP = 2000
UNKNOWN = "und"
# Words a task counts at a time, with the last slice below 2 ** 21: three ids fit 64 bits.
BATCH_WORDS = 1_500_000
SLICE_BYTES = 1 << 20
# Text whose phrases form one range of prefixes: what a task unites at a time.
RANGE_BYTES = 6_000_000
LOOKUP_ROWS = 500_000
SALTS = 8
_ID_BITS = 21
_MIX = np.uint64(0x9E3779B97F4A7C15)

# Breaks between pieces become a word of their own, a full stop, which no text word is.
_BREAK = b"."
_GAP = re.compile(rb"[ \t.]")
_FOLD = bytes(
    ord(".") if chr(c) in ".,;:!?\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256)
)


def slices(text: str) -> Iterator[list[bytes]]:
    """Words of a text and breaks, a slice at a time; slices end between words."""
    data = text.encode().translate(_FOLD)
    start = 0
    while start < len(data):
        end = start + SLICE_BYTES
        if end < len(data):
            stop = _GAP.search(data, end)
            end = stop.start() if stop else len(data)
        yield data[start:end].replace(_BREAK, b" . ").split()
        start = end


def _smallest(values: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest type that holds them."""
    top = int(values.max(initial=0))
    kinds = (np.uint8, np.uint16, np.uint32, np.uint64)
    return values.astype(next(k for k in kinds if top <= np.iinfo(k).max))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows."""
    if not len(columns[0]):
        return np.empty(0, dtype=np.int64)
    new = np.zeros(len(columns[0]), dtype=bool)
    new[0] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` for ``sizes[i]`` items each."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class CountAutomaton:
    """Counts of phrases of up to three labels; see the module's description.

    ``first`` has one row for each first label (``label, weight, fan``), ``second``
    the arcs after them (``label, weight, state``), ``states`` the distinct states
    behind those (``fan``) and ``third`` their arcs (``label, weight``). A weight of
    zero marks a prefix that is no phrase itself.
    """

    FIELDS = ("label1", "weight1", "fan1", "label2", "weight2", "state2", "fan3", "label3", "weight3")

    def __init__(self, **arrays: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def of_sorted(cls, labels: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> "CountAutomaton":
        """From distinct phrases in order: rows of three labels (0 if absent), lengths, counts.

        A prefix stands before the phrases that continue it.
        """
        one, two, three = labels.T
        pairs = _runs(one, two, sizes > 1)
        pairs = pairs[sizes[pairs] > 1]
        pair_keys = one[pairs], two[pairs]
        starts = _runs(one)
        # The last arcs: those of length three, grouped by the pair before them.
        deep = sizes == 3
        owner = np.searchsorted(pairs, np.flatnonzero(deep), side="right") - 1
        fans = np.bincount(owner, minlength=len(pairs)).astype(np.int64)
        state, reps = _shared_states(fans, three[deep], counts[deep])
        begins = np.cumsum(fans) - fans
        arcs = _places(begins[reps], fans[reps])
        return cls(
            label1=one[starts],
            weight1=np.where(sizes[starts] == 1, counts[starts], 0),
            fan1=np.bincount(np.searchsorted(starts, pairs, side="right") - 1, minlength=len(starts)),
            label2=pair_keys[1],
            weight2=np.where(sizes[pairs] == 2, counts[pairs], 0),
            state2=state,
            fan3=fans[reps],
            label3=three[deep][arcs],
            weight3=counts[deep][arcs],
        )

    def expand(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All phrases: labels, lengths and counts, in no particular order."""
        one = np.repeat(self.label1, self.fan1.astype(np.int64))
        fans = self.fan3.astype(np.int64)
        begins = np.cumsum(fans) - fans
        state = self.state2.astype(np.int64)
        per_pair = fans[state]
        arcs = _places(begins[state], per_pair)
        zero = np.zeros(len(self.label1), dtype=np.uint64)
        zeros = np.zeros(len(one), dtype=np.uint64)
        labels = np.concatenate(
            [
                np.stack([self.label1, zero, zero], axis=1),
                np.stack([one, self.label2, zeros], axis=1),
                np.stack([np.repeat(one, per_pair), np.repeat(self.label2, per_pair), self.label3[arcs]], axis=1),
            ]
        )
        counts = np.concatenate([self.weight1, self.weight2, self.weight3[arcs]]).astype(np.int64)
        sizes = np.repeat([1, 2, 3], [len(zero), len(one), len(arcs)])
        real = counts > 0
        return labels[real], sizes[real], counts[real]

    @classmethod
    def union(cls, automata: list["CountAutomaton"]) -> "CountAutomaton":
        """One automaton with the sums of the weights."""
        parts = [a.expand() for a in automata]
        return cls.of_sorted(*summed(*[np.concatenate(c) for c in zip(*parts)]))

    def to_bytes(self) -> bytes:
        arrays = [
            getattr(self, n) if n.startswith("label") else _smallest(getattr(self, n)) for n in self.FIELDS
        ]
        head = np.array([[len(a), a.dtype.itemsize] for a in arrays], dtype=np.int64)
        return head.tobytes() + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def from_bytes(cls, data: bytes) -> "CountAutomaton":
        head = np.frombuffer(data, dtype=np.int64, count=2 * len(cls.FIELDS)).reshape(-1, 2)
        place, arrays = head.nbytes, {}
        for name, (length, width) in zip(cls.FIELDS, head.tolist()):
            arrays[name] = np.frombuffer(data, dtype=f"<u{width}", count=length, offset=place)
            place += length * width
        return cls(**arrays)

    def lookup(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Counts of phrases of one label (``two`` is 0) or two; 0 where unknown."""
        if not len(self.label1):
            return np.zeros(len(one), dtype=np.int64)
        spot = np.searchsorted(self.label1, one).clip(0, len(self.label1) - 1)
        known = self.label1[spot] == one
        found = np.where(known & (two == 0), self.weight1[spot], 0).astype(np.int64)
        ask = np.flatnonzero(known & (two != 0) & (self.fan1[spot] > 0))
        fan = self.fan1.astype(np.int64)
        low = (np.cumsum(fan) - fan)[spot[ask]]
        high = low + fan[spot[ask]]
        end, wanted = high.copy(), two[ask]
        while (low < high).any():
            middle = (low + high) // 2
            less = (self.label2[middle.clip(0, len(self.label2) - 1)] < wanted) & (low < high)
            low, high = np.where(less, middle + 1, low), np.where(less | (low >= high), high, middle)
        place = low.clip(0, max(len(self.label2) - 1, 0))
        hit = (low < end) & (self.label2[place] == wanted) if len(ask) else np.empty(0, dtype=bool)
        found[ask] = np.where(hit, self.weight2[place], 0) if len(ask) else 0
        return found


def _shared_states(
    fans: np.ndarray, labels: np.ndarray, weights: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Number of the state behind each pair, and one pair of every distinct state.

    States with equal hashes are compared arc by arc; one that differs stays alone.
    """
    if not len(fans):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    begins = np.cumsum(fans) - fans
    place = np.arange(len(labels)) - np.repeat(begins, fans)
    mixed = (labels ^ (weights.astype(np.uint64) * _MIX)) * (_MIX + place.astype(np.uint64) * np.uint64(2))
    mixed ^= mixed >> np.uint64(31)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed)])
    marks = (total[begins + fans] - total[begins]) * _MIX + fans.astype(np.uint64)
    _, rep, inverse = np.unique(marks, return_index=True, return_inverse=True)
    chosen = rep[inverse]
    same = fans == fans[chosen]
    arcs = np.repeat(begins[chosen], fans) + place
    arcs = np.minimum(arcs, max(len(labels) - 1, 0))
    if len(labels):
        unequal = (labels[arcs] != labels) | (weights[arcs] != weights)
        same &= np.bincount(np.repeat(np.arange(len(fans)), fans), unequal, len(fans)) == 0
    chosen = np.where(same, chosen, np.arange(len(fans)))
    reps, state = np.unique(chosen, return_inverse=True)
    return state, reps


def summed(labels: np.ndarray, sizes: np.ndarray, counts: np.ndarray):
    """Distinct phrases in order, with the sums of their counts."""
    order = np.lexsort((labels[:, 2], sizes, labels[:, 1], labels[:, 0]))
    labels, sizes, counts = labels[order], sizes[order], counts[order]
    starts = _runs(*labels.T, sizes)
    if not len(starts):
        return labels, sizes, counts
    return labels[starts], sizes[starts], np.add.reduceat(counts, starts)


class _Counter:
    """Counts the phrases of the texts of one language, batch by batch."""

    def __init__(self, lang: str):
        self.lang, self.parts, self.words, self.carried = lang, [], 0, 0

    def add(self, words: list[bytes]) -> None:
        self.parts.append(words)
        self.words += len(words)

    def take(self):
        """Words with hashes and counts, and sorted phrases of two and three words.

        The last two words go over to the next batch, so that no phrase is lost; they
        are not counted as words again.
        """
        words = [word for part in self.parts for word in part]
        vocabulary = {word: number for number, word in enumerate(dict.fromkeys(words))}
        spelled = list(vocabulary)
        hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in spelled], dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        ids = rank[np.fromiter(map(vocabulary.__getitem__, words), dtype=np.int64, count=len(words))]
        is_word = np.ones(len(words), dtype=bool)
        if _BREAK in vocabulary:
            is_word = ids != rank[vocabulary[_BREAK]]
        new = np.arange(len(ids)) >= self.carried
        once, n = np.unique(ids[is_word & new], return_counts=True)
        found = []
        for size in (2, 3):
            last = max(0, len(ids) - size + 1)
            key = np.zeros(last, dtype=np.uint64)
            whole = new[size - 1 :].copy()
            for i in range(size):
                key = (key << np.uint64(_ID_BITS)) | ids[i : i + last].astype(np.uint64)
                whole &= is_word[i : i + last]
            found.append(np.unique(key[whole], return_counts=True))
        label = hashes[order]
        mask = np.uint64((1 << _ID_BITS) - 1)
        (two, two_n), (three, three_n) = found
        shift, twice = np.uint64(_ID_BITS), np.uint64(2 * _ID_BITS)
        pairs = np.stack([label[two >> shift], label[two & mask], np.zeros(len(two), dtype=np.uint64)], axis=1)
        triples = np.stack(
            [label[three >> twice], label[(three >> shift) & mask], label[three & mask]], axis=1
        )
        labels = np.concatenate([pairs, triples])
        sizes = np.repeat([2, 3], [len(two), len(three)])
        counts = np.concatenate([two_n, three_n])
        self.parts = [words[-2:]]
        self.words = self.carried = len(self.parts[0])
        spelling = [spelled[i] for i in order[once]]
        return label[once], n, spelling, labels, sizes, counts


_COUNTED = "lang string, part long, automaton binary, labels binary, counts binary, words binary"


def _counted(ranges: int):
    """Texts to automata by language and range of prefixes."""
    count = np.uint64(ranges)

    def rows(counter: _Counter) -> Iterator[pa.RecordBatch]:
        label, n, spelling, labels, sizes, counts = counter.take()
        pair = (labels[:, 0] * _MIX) ^ labels[:, 1]
        part = ((pair ^ (pair >> np.uint64(32))) * _MIX >> np.uint64(20)) % count
        order = np.lexsort((labels[:, 2], sizes, labels[:, 1], labels[:, 0], part))
        edges = np.searchsorted(part[order], np.arange(ranges + 1, dtype=np.uint64))
        own = (label >> np.uint64(20)) % count
        own_order = np.argsort(own, kind="stable")
        own_edges = np.searchsorted(own[own_order], np.arange(ranges + 1, dtype=np.uint64))
        for number in range(ranges):
            chosen = order[edges[number] : edges[number + 1]]
            words = own_order[own_edges[number] : own_edges[number + 1]]
            if not len(chosen) and not len(words):
                continue
            built = CountAutomaton.of_sorted(labels[chosen], sizes[chosen], counts[chosen])
            values = [
                counter.lang,
                number,
                built.to_bytes(),
                label[words].tobytes(),
                n[words].astype(np.int64).tobytes(),
                _BREAK.join(spelling[i] for i in words.tolist()),
            ]
            kinds = [pa.string(), pa.int64(), *[pa.binary()] * 4]
            columns = [pa.array([v], k) for v, k in zip(values, kinds)]
            yield pa.RecordBatch.from_arrays(
                columns, ["lang", "part", "automaton", "labels", "counts", "words"]
            )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, _Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counter = counters.get(lang)
                if counter is None:
                    counter = counters[lang] = _Counter(lang)
                for words in slices(text.as_py()):
                    counter.add(words)
                    if counter.words >= BATCH_WORDS:
                        yield from rows(counter)
                counter.add([_BREAK])
            # All languages together stay within a batch.
            while sum(c.words for c in counters.values()) >= BATCH_WORDS:
                yield from rows(counters.pop(max(counters, key=lambda k: counters[k].words)))
        for counter in counters.values():
            yield from rows(counter)

    return counted


_FREQUENT = (
    "lang string, size int, one long, two long, three long, f long, prefix long, word string"
)


def _row_by_row(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch may hold many automata; one is taken out at a time."""
    for i in range(len(batch)):
        yield batch.slice(i, 1).to_pylist()[0]


def _united(least: int):
    """Unites the automata of every language and range; frequent phrases leave.

    ``prefix`` is the count of the first two words of three. A row of size 0 has the
    number of words of the language in the range.
    """

    def united_rows(lang: str, held: list[dict]) -> pa.RecordBatch:
        labels = np.concatenate([np.frombuffer(r["labels"], dtype=np.uint64) for r in held])
        counts = np.concatenate([np.frombuffer(r["counts"], dtype=np.int64) for r in held])
        words = [w for r in held if r["words"] for w in r["words"].split(_BREAK)]
        total = int(counts.sum())
        once, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
        sums = np.zeros(len(once), dtype=np.int64)
        np.add.at(sums, inverse, counts)
        often = np.flatnonzero(sums >= least)
        spelled = [words[i].decode() for i in first[often].tolist()]
        whole = CountAutomaton.union([CountAutomaton.from_bytes(r["automaton"]) for r in held])
        phrases, sizes, f = whole.expand()
        keep = f >= least
        phrases, sizes, f = phrases[keep], sizes[keep], f[keep]
        prefix = np.where(sizes == 3, whole.lookup(phrases[:, 0], phrases[:, 1]), 0)
        n = 1 + len(often) + len(f)
        table = np.zeros((n, 3), dtype=np.uint64)
        table[1 : 1 + len(often), 0] = once[often]
        table[1 + len(often) :] = phrases
        columns = [
            pa.array([lang] * n, pa.string()),
            pa.array(np.concatenate([[0], np.ones(len(often), dtype=int), sizes]).astype(np.int32)),
            *[pa.array(column.view(np.int64)) for column in np.ascontiguousarray(table.T)],
            pa.array(np.concatenate([[total], sums[often], f]).astype(np.int64)),
            pa.array(np.concatenate([np.zeros(1 + len(often), dtype=int), prefix]).astype(np.int64)),
            pa.array([None, *spelled, *[None] * len(f)], pa.string()),
        ]
        names = ["lang", "size", "one", "two", "three", "f", "prefix", "word"]
        return pa.RecordBatch.from_arrays(columns, names)

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for row in _row_by_row(batch):
                if key != (row["lang"], row["part"]):
                    if held:
                        yield united_rows(key[0], held)
                    key, held = (row["lang"], row["part"]), []
                held.append(row)
        if held:
            yield united_rows(key[0], held)

    return united


def frequent_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST
) -> DataFrame:
    """Settled phrases of one to three words with at least ``least`` occurrences."""
    ship(docs.sparkSession)
    texts = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, ceil(size / RANGE_BYTES))
    counted = texts.mapInArrow(_counted(ranges), _COUNTED)
    # A task unites few ranges, however large the input.
    tasks = max(ranges, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = counted.repartition(tasks, "part").sortWithinPartitions("part", "lang")
    return settle(dealt.mapInArrow(_united(least), _FREQUENT), "phrases")


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of a partition come first and make an automaton; requests are looked up."""
    held, built = [], None
    for batch in batches:
        asking = batch.column("asking").to_numpy(zero_copy_only=False).astype(bool)
        if not asking.all():
            held.append(batch.filter(pa.array(~asking)))
        if not asking.any():
            continue
        if built is None:
            built = _by_lang(held)
        asked = batch.filter(pa.array(asking))
        langs = np.array(asked.column("lang").to_pylist(), dtype=object)
        one, two = (asked.column(c).to_numpy().view(np.uint64) for c in ("part1", "part2"))
        found = np.zeros(len(asked), dtype=np.int64)
        for lang in set(langs.tolist()):
            if lang in built:
                mine = langs == lang
                found[mine] = built[lang].lookup(one[mine], two[mine])
        columns = [asked.column(c) for c in ("lang", "one", "two", "three", "role")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(found)], ["lang", "one", "two", "three", "role", "f"]
        )


def _by_lang(held: list[pa.RecordBatch]) -> dict[str, CountAutomaton]:
    if not held:
        return {}
    entries = pa.Table.from_batches(held)
    langs = np.array(entries.column("lang").to_pylist(), dtype=object)
    one, two = (entries.column(c).to_numpy().view(np.uint64) for c in ("part1", "part2"))
    f = entries.column("f").to_numpy()
    built = {}
    for lang in set(langs.tolist()):
        mine = langs == lang
        # Copies of a part may have come to the same partition.
        order = np.flatnonzero(mine)[np.lexsort((two[mine], one[mine]))]
        order = order[_runs(one[order], two[order])]
        labels = np.stack([one[order], two[order], np.zeros(len(order), dtype=np.uint64)], axis=1)
        built[lang] = CountAutomaton.of_sorted(labels, np.where(two[order] == 0, 1, 2), f[order])
    return built


def part_counts(frequent: DataFrame) -> DataFrame:
    """Phrases of two and three words with the counts of their parts.

    ``first1`` and ``rest1`` are the parts of the cut after one word, ``first2`` and
    ``rest2`` those of the cut after two.
    """
    zero = F.lit(0).cast("long")
    phrase = ["lang", "one", "two", "three"]

    def part(role: str, one: Column, two: Column = zero) -> Column:
        return F.struct(F.lit(role).alias("role"), one.alias("part1"), two.alias("part2"))

    one, two, three = F.col("one"), F.col("two"), F.col("three")
    pair = F.array(part("first1", one), part("rest1", two))
    triple = F.array(part("first1", one), part("rest1", two, three), part("rest2", three))
    candidates = frequent.filter("size > 1")
    requests = candidates.select(
        *phrase,
        F.inline(F.when(F.col("size") == 2, pair).otherwise(triple)),
        zero.alias("f"),
        F.lit(True).alias("asking"),
        F.pmod(F.xxhash64(*phrase), F.lit(SALTS)).cast("int").alias("salt"),
    )
    entries = frequent.filter("size in (1, 2)").select(
        *phrase,
        F.lit("").alias("role"),
        F.col("one").alias("part1"),
        F.col("two").alias("part2"),
        "f",
        F.lit(False).alias("asking"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    spark = frequent.sparkSession
    ranges = ceil(frequent.count() * SALTS / LOOKUP_ROWS)
    ranges = max(ranges, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = entries.unionByName(requests).repartition(ranges, "lang", "part1", "part2", "salt")
    answers = met.sortWithinPartitions("asking").mapInArrow(
        _answers, "lang string, one long, two long, three long, role string, f long"
    )
    found = answers.groupBy(*phrase).agg(
        *[F.max(F.when(F.col("role") == r, F.col("f"))).alias(r) for r in ("first1", "rest1", "rest2")]
    )
    return candidates.join(found, phrase).select(
        *phrase, "size", F.col("f").alias("a"), "first1", "rest1", F.col("prefix").alias("first2"), "rest2"
    )


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    share: int = SHARE,
    top: int = TOP,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` collocations by language.

    A phrase is scored by its weakest cut. It gives way to a longer phrase that holds
    it and has ``share`` hundredths of its occurrences or more.
    """
    frequent = frequent_phrases(docs, text, lang, least)
    parts = settle(part_counts(frequent), "parts")
    quotient = "cast((1000000 * a * a) div (cast({0} as decimal(19,0)) * {1}) as long)"
    a = F.col("a").cast("decimal(16,0)")
    exact = parts.withColumns({"a": a, **{c: F.col(c).cast("decimal(19,0)") for c in ("first1", "rest1", "first2", "rest2")}})
    first = F.struct(
        F.expr(quotient.format("first1", "rest1")).alias("score"),
        F.lit(1).alias("k"),
        F.col("first1").alias("l"),
        F.col("rest1").alias("r"),
    )
    second = F.struct(
        F.expr(quotient.format("first2", "rest2")).alias("score"),
        F.lit(2).alias("k"),
        F.col("first2").alias("l"),
        F.col("rest2").alias("r"),
    )
    cut = F.when(F.col("size") == 2, first).otherwise(F.least(first, second))
    scored = exact.withColumn("cut", cut)
    longer = parts.filter("size = 3")
    inner = longer.select("lang", "one", "two", "a").unionByName(
        longer.select("lang", F.col("two").alias("one"), F.col("three").alias("two"), "a")
    )
    inner = inner.groupBy("lang", "one", "two").agg(F.max("a").alias("inside"))
    inner = inner.withColumn("three", F.lit(0).cast("long"))
    left = scored.join(inner, ["lang", "one", "two", "three"], "left").filter(
        F.col("inside").isNull() | (F.col("size") == 3) | (100 * F.col("inside") < share * F.col("a"))
    )
    words = frequent.filter("size = 1").select("lang", F.col("one").alias("label"), "word")
    for place in ("one", "two", "three"):
        spelled = words.select("lang", F.col("label").alias(place), F.col("word").alias(f"{place}_word"))
        left = left.join(spelled, ["lang", place], "left")
    phrase = F.concat_ws(" ", "one_word", "two_word", F.when(F.col("size") == 3, F.col("three_word")))
    totals = frequent.filter("size = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        left.select(
            "lang",
            phrase.alias("phrase"),
            F.col("a").cast("long").alias("a"),
            *[F.col(f"cut.{c}").cast("long").alias(c) for c in ("l", "r", "score")],
        )
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
