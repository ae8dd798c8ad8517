"""Quality rules whose cutoffs carry a guarantee against rejecting good documents.

Every rule compares one ratio of a document with a cutoff. For each stratum
(language) and rule, the labelled good documents that pass the base rule are the
holdout. Cutoffs are tried from the most lenient to the strictest; one is
certified while the exact binomial tail says that, were its true false-rejection
rate above ``alpha / rules``, so few rejections among the holdout would have a
probability of at most ``delta / (strata * rules)``. The walk stops at the first
cutoff that is not certified, so no correction is needed within it (fixed-sequence
testing); across strata and rules the level is divided (Bonferroni). By the union
bound, with probability ``1 - delta`` every stratum loses at most ``alpha`` of its
good documents. Of the certified cutoffs, the one that rejects most bad documents
net of good ones is taken, ties to the more lenient. A stratum with too few labels
certifies nothing and rejects nothing.

Defined cases: a null or blank text has no words and fails the base rule. A null
or unlisted language falls into the stratum ``other``. Repeated documents are
judged row by row; a document with several labels counts as good only if all are
1. Empty tables give empty results. Only the named columns are read.
"""

import math
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterloom.llm.ship import ship
from counterloom.llm.text import WORD_GAPS, count_of
from counterloom.shared import settle

SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LANGUAGES = ("de", "en", "es", "fr")
OTHER = "other"
STEPS = 33

_STATISTICS = pa.struct(
    [
        (name, pa.int64())
        for name in (
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            "n_lines",
            "n_upper",
        )
    ]
)


class Rule(NamedTuple):
    """Rejects documents whose ``top / bottom`` is above a cutoff."""

    name: str
    top: str
    bottom: str
    lenient: float
    strict: float

    def cutoffs(self) -> list[float]:
        ratio = self.strict / self.lenient
        return [self.lenient * ratio ** (i / (STEPS - 1)) for i in range(STEPS)]

    def value(self) -> Column:
        return F.col(self.top) / F.greatest(F.col(self.bottom), F.lit(1))


RULES = (
    Rule("symbols per word", "n_symbols", "n_words", 4.0, 0.05),
    Rule("repeated lines", "n_dup_lines", "n_lines", 0.9, 0.05),
    Rule("repeated words", "n_repeat_words", "n_words", 0.5, 0.05),
    Rule("upper case", "n_upper", "word_chars", 0.9, 0.05),
    Rule("long words", "word_chars", "n_words", 60.0, 6.0),
)


def text_statistics(text: str | None) -> tuple[int, ...]:
    """Counts of one whole text, in the order of ``_STATISTICS``."""
    data = (text or "").encode()
    words = data.split()
    gaps = count_of(data, WORD_GAPS)
    lines = [line for line in data.split(b"\n") if line.strip(WORD_GAPS)]
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    repeated = 0
    if len(seen) < len(windows):
        covered = bytearray(len(words))
        for i, window in enumerate(windows):
            if seen[window] > 1:
                covered[i : i + 3] = b"\1\1\1"
        repeated = covered.count(1)
    return (
        len(words),
        len(text or "") - gaps,
        count_of(data, SYMBOLS),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        count_of(data, UPPER),
    )


def _statistics(texts: pa.Array) -> pa.Array:
    rows = [text_statistics(text.as_py()) for text in texts]
    columns = [list(c) for c in zip(*rows)] or [[] for _ in _STATISTICS]
    arrays = [pa.array(c, pa.int64()) for c in columns]
    return pa.StructArray.from_arrays(arrays, fields=list(_STATISTICS))


def statistics(text: Column) -> Column:
    """The counts of a text; not "deterministic", or it would be computed once per use."""
    kind = T.StructType([T.StructField(f.name, T.LongType()) for f in _STATISTICS])
    return F.arrow_udf(_statistics, kind).asNondeterministic()(text)


def base_failed() -> Column:
    few = F.col("n_words") < 50
    return few | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def stratum_of(lang: str, languages: tuple[str, ...] = LANGUAGES) -> Column:
    known = F.col(lang).isin(*languages)
    return F.when(known, F.col(lang)).otherwise(F.lit(OTHER))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), by the continued fraction of the beta integral."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1.0 - p

    def fraction(a: float, b: float, x: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1), tiny)
        total, m = d, 1
        while m < 100_000:
            for step in (
                m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
            ):
                d = 1.0 + step * d
                c = 1.0 + step / c
                d = 1.0 / (d if abs(d) > tiny else tiny)
                c = c if abs(c) > tiny else tiny
                total *= c * d
            if abs(c * d - 1.0) < 1e-13:
                break
            m += 1
        return total

    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(front + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1.0 - front * fraction(b, a, 1.0 - x) / b


def certified_cutoff(
    cutoffs: list[float],
    good: list[int],
    bad: list[int],
    alpha: float,
    delta: float,
) -> float | None:
    """The best certified cutoff.

    ``cutoffs`` go from lenient to strict; ``good[i]`` and ``bad[i]`` count the
    documents above exactly the i strictest of them.
    """
    total = sum(good)
    best, best_gain = None, 0
    for i, cutoff in enumerate(cutoffs):
        reached = len(cutoffs) - i
        rejected = sum(good[reached:])
        if total == 0 or binomial_tail(rejected, total, alpha) > delta:
            break
        gain = sum(bad[reached:]) - rejected
        if gain > best_gain:
            best, best_gain = cutoff, gain
    return best


def label_per_document(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    known = labels.filter(F.col("quality").isin(0, 1) & F.col(doc_id).isNotNull())
    return known.groupBy(F.col(doc_id).alias("doc_id")).agg(F.min("quality").alias("quality"))


def select_cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    alpha: float = 0.02,
    delta: float = 0.05,
    languages: tuple[str, ...] = LANGUAGES,
) -> dict[tuple[str, str], float]:
    """Cutoff by (stratum, rule) from ``measured`` (doc_id, stratum, counts) and labels.

    All labelled rows are counted in Spark; what returns to the driver is one
    count per stratum, label, rule and grid step: fewer than 2000 rows for four
    languages, whatever the size of the tables.
    """
    strata = (*languages, OTHER)
    levels = []
    for rule in RULES:
        above = [F.when(rule.value() > c, 1).otherwise(0) for c in rule.cutoffs()]
        level = sum(above[1:], above[0])
        levels.append(F.struct(F.lit(rule.name).alias("rule"), level.alias("level")))
    counts = (
        measured.filter(~base_failed())
        .join(label_per_document(labels), "doc_id")
        .select("stratum", "quality", F.inline(F.array(*levels)))
        .groupBy("stratum", "quality", "rule", "level")
        .count()
        .collect()
    )
    table = Counter({(r.stratum, r.rule, r.quality, r.level): r["count"] for r in counts})
    chosen = {}
    for stratum in strata:
        for rule in RULES:
            good, bad = (
                [table[stratum, rule.name, quality, i] for i in range(STEPS + 1)]
                for quality in (1, 0)
            )
            cutoff = certified_cutoff(
                rule.cutoffs(),
                good,
                bad,
                alpha / len(RULES),
                delta / (len(RULES) * len(strata)),
            )
            if cutoff is not None:
                chosen[stratum, rule.name] = cutoff
    return chosen


def passes(cutoffs: dict[tuple[str, str], float]) -> Column:
    """True where no certified rule of the row's stratum is broken."""
    verdict = F.lit(True)
    for rule in RULES:
        for stratum, name in cutoffs:
            if name == rule.name:
                broken = (F.col("stratum") == stratum) & (rule.value() > cutoffs[stratum, name])
                verdict = verdict & ~broken
    return verdict


def measure(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        stratum_of(lang).alias("stratum"),
        statistics(F.col(text)).alias("counts"),
    ).select("doc_id", "stratum", "counts.*")


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    alpha: float = 0.02,
    delta: float = 0.05,
) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of every document."""
    measured = settle(measure(docs, doc_id, text, lang), "rule-counts")
    cutoffs = select_cutoffs(measured, labels, alpha, delta)
    return (
        measured.withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & passes(cutoffs))
        .drop("stratum", "n_lines", "n_upper")
    )


def keep_quality(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    alpha: float = 0.02,
    delta: float = 0.05,
) -> DataFrame:
    """The documents that pass, with all their columns; texts are never shuffled."""
    measured = settle(measure(docs, doc_id, text, lang), "rule-counts")
    cutoffs = select_cutoffs(measured, labels, alpha, delta)
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    judged = docs.select(row, F.col(text).alias("text"), stratum_of(lang).alias("stratum"))
    judged = judged.select("row", "stratum", statistics(F.col("text")).alias("counts"))
    return (
        judged.select("row", "stratum", "counts.*")
        .filter(~base_failed() & passes(cutoffs))
        .select("row.*")
    )
