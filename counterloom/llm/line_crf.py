"""A linear-chain conditional random field that labels every line good or bad.

A line is described by thresholds on ratios of its own characters and by those of
the line before and after it. The field has two states, one weight per feature
and a score per transition; it is trained by gradient ascent on the exact
log-likelihood (forward-backward), every line carrying the label of its document.
The quality of a document is the mean of its lines' marginal probabilities of
"good", weighted by line length.

Training takes a bounded sample, set by parameters: of the documents that are there
and labelled the ``sample_docs`` with the smallest hash of their id, and of each at
most ``sample_lines`` consecutive lines. Scores use whole texts.

Defined cases: lines without a word are skipped; a null or blank text is scored
as one empty line. Without two classes of labels, every score is the smoothed
share of good labels. Repeated documents are scored row by row; documents with
contradicting labels are not learnt from. Only the named columns are read.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterloom.llm.ship import ship
from counterloom.llm.text import WORD_GAPS, count_of, remainder_of_id

FOLDS = 5
HELD_OUT = 0
CUT = 0.3

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = _UPPER + _UPPER.lower()
_DIGITS = b"0123456789"
_ODD = b"#*$%&<>{}[]\\^~_=+@/"
_STOPS = b".,;:!?'\"()-"
_ENDS = (b".", b"!", b"?", b":", b";")

# A ratio becomes one feature per threshold that it exceeds.
_RATIOS = ("odd", "upper", "digits", "stops", "pipes", "shouts", "spread", "tagged")
_THRESHOLDS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6)
_FLAGS = 9
OWN = len(_RATIOS) * len(_THRESHOLDS) + _FLAGS
WIDTH = 3 * OWN + 3


class Field(NamedTuple):
    """Weights of "good" over "bad" per feature, and transition scores [from, to]."""

    weights: np.ndarray
    moves: np.ndarray


def _ratios(line: bytes, words: list[bytes]) -> tuple[float, ...]:
    solid = len(line) - count_of(line, WORD_GAPS)
    letters = count_of(line, _LETTERS)
    return (
        count_of(line, _ODD) / solid,
        count_of(line, _UPPER) / max(letters, 1),
        count_of(line, _DIGITS) / solid,
        count_of(line, _STOPS) / solid,
        line.count(b"|") / len(words),
        line.count(b"!") / len(words),
        1.0 - len(set(words)) / len(words),
        sum(word[-1] in _ODD for word in words) / len(words),
    )


def _flags(line: bytes, words: list[bytes], repeated: bool) -> tuple[bool, ...]:
    width = (len(line) - len(words) + 1) / len(words)
    return (
        repeated,
        len(words) == 1,
        len(words) < 4,
        len(words) < 10,
        len(words) > 100,
        line.endswith(_ENDS),
        width < 3,
        width > 7,
        width > 12,
    )


def text_lines(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Ratios and flags of the lines of a text, and the lines' lengths."""
    seen: set[bytes] = set()
    rows, lengths = [], []
    for line in (text or "").encode().split(b"\n"):
        line = line.strip(WORD_GAPS)
        if line:
            words = line.split()
            rows.append((*_ratios(line, words), *_flags(line, words, line in seen)))
            lengths.append(len(line))
            seen.add(line)
    if not rows:
        rows, lengths = [(0.0,) * (len(_RATIOS) + _FLAGS)], [1]
    return np.array(rows, dtype=np.float32), np.array(lengths, dtype=np.float64)


def features(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Own, previous and next features of all lines; ``starts``: first line of each text."""
    steps = [raw[:, : len(_RATIOS)] > t for t in _THRESHOLDS]
    own = np.concatenate([*steps, raw[:, len(_RATIOS) :] > 0], axis=1).astype(np.float32)
    first = np.zeros(len(own), dtype=bool)
    first[starts] = True
    last = np.roll(first, -1)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first] = 0
    after[last] = 0
    ends = np.stack([np.ones(len(own)), first, last], axis=1).astype(np.float32)
    return np.concatenate([own, before, after, ends], axis=1)


def marginals(
    scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, moves: np.ndarray
) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of every line, expected transitions, and the sum of log partition values.

    All texts advance together, one line a step; longer texts stay in longer.
    Messages are odds-like pairs, rescaled to sum 1 at every step.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    power = np.exp(moves)
    top = np.maximum(scores, 0)
    local = np.stack([np.exp(-top), np.exp(scores - top)], axis=1)
    forward, backward = np.empty_like(local), np.ones_like(local)
    log_z = float(top.sum())
    live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes[0]))]
    for t, n in enumerate(live):
        at = starts[:n] + t
        message = local[at] if t == 0 else (forward[at - 1] @ power) * local[at]
        total = message.sum(axis=1, keepdims=True)
        log_z += float(np.log(total).sum())
        forward[at] = message / total
    expected = np.zeros((2, 2))
    for t in range(len(live) - 1, 0, -1):
        at = starts[: live[t]] + t
        ahead = local[at] * backward[at]
        message = ahead @ power.T
        pair = forward[at - 1][:, :, None] * power[None] * ahead[:, None, :]
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        backward[at - 1] = message / message.sum(axis=1, keepdims=True)
    joint = forward * backward
    return joint[:, 1] / joint.sum(axis=1), expected, log_z


def fit(
    texts: list[np.ndarray], labels: np.ndarray, rounds: int = 150, penalty: float = 3.0
) -> Field:
    """Maximum penalised likelihood; ``texts``: raw line rows of each training text."""
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
    x = features(np.concatenate(texts), starts)
    y = np.repeat(labels, sizes).astype(np.float64)
    stays = np.zeros((2, 2))
    for label in (0, 1):
        stays[label, label] = (sizes[labels == label] - 1).sum()
    weights, moves = np.zeros(WIDTH), np.zeros((2, 2))
    moment, square = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, rounds + 1):
        good, expected, _ = marginals(x @ weights, starts, sizes, moves)
        slope = np.concatenate([x.T @ (y - good) - penalty * weights, (stays - expected).ravel()])
        slope[WIDTH:] -= penalty * moves.ravel()
        slope /= len(texts)
        moment = 0.9 * moment + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        rate = 0.1 * min(1.0, 2.0 * (1 - (step - 1) / rounds))
        move = (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights = weights + rate * move[:WIDTH]
        moves = moves + rate * move[WIDTH:].reshape(2, 2)
    return Field(weights, moves)


def constant_field(good: int, total: int) -> Field:
    """Every line, and so every text, has the smoothed share of good labels."""
    weights = np.zeros(WIDTH)
    weights[3 * OWN] = np.log((good + 1) / (total - good + 1))
    return Field(weights, np.zeros((2, 2)))


def score_texts(texts: list[tuple[np.ndarray, np.ndarray]], field: Field) -> np.ndarray:
    sizes = np.array([len(lengths) for _, lengths in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
    lengths = np.concatenate([lengths for _, lengths in texts])
    x = features(np.concatenate([raw for raw, _ in texts]), starts)
    good, _, _ = marginals(x @ field.weights, starts, sizes, field.moves)
    share = np.add.reduceat(good * lengths, starts) / np.add.reduceat(lengths, starts)
    return np.clip(share, 0.0, 1.0)


_BATCH_LINES = 50_000


def score(text: Column, field: Field) -> Column:
    """The quality of whole texts; one Python pass, nothing is shuffled."""

    def scored(column: pa.Array) -> pa.Array:
        out, pending, lines = [], [], 0
        for value in column:
            pending.append(text_lines(value.as_py()))
            lines += len(pending[-1][1])
            if lines >= _BATCH_LINES:
                out.append(score_texts(pending, field))
                pending, lines = [], 0
        if pending:
            out.append(score_texts(pending, field))
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return F.arrow_udf(scored, T.DoubleType()).asNondeterministic()(text)


def _raw_lines(limit: int):
    def described(texts: pa.Array, places: pa.Array) -> pa.Array:
        rows = []
        for text, place in zip(texts, places):
            raw, _ = text_lines(text.as_py())
            first = place.as_py() % max(1, len(raw) - limit + 1)
            rows.append(raw[first : first + limit].tobytes())
        return pa.array(rows, pa.binary())

    return F.arrow_udf(described, T.BinaryType())


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    sample_docs: int = 4000,
    sample_lines: int = 40,
) -> Field:
    """Fit on labelled documents outside the held-out fold; the sample is bounded."""
    ship(docs.sparkSession)
    known = labels.filter(
        F.col("quality").isin(0, 1)
        & F.col("doc_id").isNotNull()
        & (remainder_of_id("doc_id", FOLDS) != HELD_OUT)
    )
    agreed = (
        known.groupBy(F.col("doc_id").alias("labelled"))
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .filter(F.col("quality") == F.col("most"))
    )
    place = F.xxhash64("labelled")
    # Labels without a document take no place in the sample.
    present = agreed.join(docs.select(F.col(doc_id).alias("labelled")), "labelled", "left_semi")
    chosen = present.orderBy(place, "labelled").limit(sample_docs)
    # At most sample_docs rows, so the broadcast is bounded.
    rows = (
        docs.select(F.col(doc_id).alias("labelled"), F.col(text).alias("text"))
        .join(F.broadcast(chosen), "labelled")
        .groupBy("labelled", "quality")
        .agg(F.min("text").alias("text"))
        .select(
            "labelled",
            "quality",
            _raw_lines(sample_lines)(F.col("text"), F.pmod(place, F.lit(1 << 30))).alias("raw"),
        )
        .collect()
    )
    rows.sort(key=lambda row: row.labelled)
    answers = np.array([row.quality for row in rows], dtype=int)
    if len(set(answers.tolist())) < 2:
        return constant_field(int(answers.sum()), len(answers))
    width = len(_RATIOS) + _FLAGS
    texts = [np.frombuffer(row.raw, dtype=np.float32).reshape(-1, width) for row in rows]
    return fit(texts, answers)


def line_quality(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    sample_docs: int = 4000,
    sample_lines: int = 40,
    known: DataFrame | None = None,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    ``known``: the documents to learn from, where ``docs`` has lost labelled ones.
    """
    source = docs if known is None else known
    field = train(source, labels, doc_id, text, sample_docs, sample_lines)
    scored = docs.select(
        F.col(doc_id).alias("doc_id"),
        (remainder_of_id(doc_id, FOLDS) == HELD_OUT).alias("held_out"),
        score(F.col(text), field).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    known: DataFrame | None = None,
) -> DataFrame:
    """The documents predicted good, with all their columns; texts are not shuffled.

    ``known``: the documents to learn from, where ``docs`` has lost labelled ones.
    """
    field = train(docs if known is None else known, labels, doc_id, text)
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    scored = docs.select(row, score(F.col(text), field).alias("score"))
    return scored.filter(F.col("score") >= CUT).select("row.*")
