"""Quality rules with thresholds whose false rejections are bounded by labelled holdouts.

A rule rejects a document whose measure lies above a cutoff. All rules are tightened
together along one fixed sequence of joint settings, `SETTINGS`, each stricter than the one
before. In each stratum (language) a setting is certified if the exact binomial probability
of seeing so few good documents rejected by any of its cutoffs, were the true rate `risk`,
is at most `doubt / strata`; that is, if its Clopper-Pearson upper bound is below the risk.
The first failure ends the sequence, so settings need no further correction (fixed-sequence
testing), and strata are corrected for by Bonferroni over those that are tested. The
strictest certified setting is used. A stratum is tested if it has enough labelled good
documents to certify a setting without a false rejection; which are tested depends on these
numbers alone, so it needs no correction. A smaller stratum gets no cutoffs: none could be
guaranteed for it, and a pool of several would only bound the pool. With probability
`1 - doubt` the cutoffs reject no more than `risk` of the good documents of any stratum; what
the base rule rejects besides is given, not learned.

Nulls, ties and the rest: a null or wordless text has no words and measures of zero; a
null language is a stratum of its own; a stratum with too few labelled good documents, or
none, is judged by the base rule alone; several labels of one document count once, as good
if any says so, and so do its repeated rows, by their greatest measures; a measure equal to the cutoff is kept; repeated rows are judged alike;
no documents give no rows; other columns are untouched.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staycohort.llm.common import if_small, materialised, small_batches, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Each rule's measure and its cutoffs, from the mildest to the strictest.
CUTOFFS = {
    "symbol_ratio": (0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05),
    "dup_line_ratio": (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5),
    "repeat_ratio": (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.5, 0.4),
    "upper_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2),
}



def _settings() -> Iterator[dict[str, float]]:
    setting = dict.fromkeys(CUTOFFS, math.inf)
    for level in zip(*CUTOFFS.values(), strict=True):
        for rule, cutoff in zip(CUTOFFS, level, strict=True):
            setting[rule] = cutoff
            yield dict(setting)


#: Joint settings of all rules: from each to the next, one rule takes its next cutoff.
SETTINGS = tuple(_settings())

#: Strata up to which their thresholds are broadcast; more are joined by key.
MOST_BROADCAST = 10_000

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of `width` words that occur twice or more in `words`.

    Windows are named exactly, by ranking pairs of shorter windows, without hashing.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    names = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    span = 1
    while span < width:
        step = min(span, width - span)
        left = names[: len(names) - step]
        pairs = left * (int(names.max()) + 1) + names[step:]
        distinct, names = np.unique(pairs, return_inverse=True)
        if len(distinct) == len(names):
            return 0
        span += step
    twice = np.bincount(names)[names] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[width : width + n] -= twice
    return int((np.cumsum(edges) > 0).sum())


def _measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    space = sum(map(data.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - space,
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    )


def with_counts(docs: DataFrame) -> DataFrame:
    """`docs` and a struct column `__counts` of what the rules measure."""
    small_batches(docs.sparkSession)
    kind = pa.struct([pa.field(c, pa.int64()) for c in _COUNTS])
    at = docs.columns.index("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_measure(t.as_py()) for t in batch.column(at)]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(_COUNTS)
            counts = pa.StructArray.from_arrays(columns, fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], [*batch.schema.names, "__counts"])

    counts = T.StructType([T.StructField(c, T.LongType()) for c in _COUNTS])
    return docs.mapInArrow(count, T.StructType([*docs.schema.fields, T.StructField("__counts", counts)]))


def _ratio(part: str, whole: str) -> Column:
    return F.coalesce(F.col(f"__counts.{part}") / F.nullif(F.col(f"__counts.{whole}"), F.lit(0)), F.lit(0.0))


#: Each measure as an expression over `__counts`.
def _measures() -> dict[str, Column]:
    return {
        "symbol_ratio": _ratio("n_symbols", "word_chars"),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": _ratio("n_repeat_words", "n_words"),
        "upper_ratio": _ratio("n_upper", "word_chars"),
    }


def base_failed() -> Column:
    """Fewer than 20 words, or over 30 % of them in repeated windows."""
    words = F.col("__counts.n_words")
    return (words < 20) | (100 * F.col("__counts.n_repeat_words") > 30 * words)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of Binomial(n, p), summed exactly in logarithms."""
    if k >= n:
        return 1.0
    log_p, log_q, top = math.log(p), math.log1p(-p), math.lgamma(n + 1)
    terms = (
        math.exp(top - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q)
        for i in range(k + 1)
    )
    return min(1.0, math.fsum(terms))


def certified[T](rejected: list[int], n: int, cutoffs: tuple[T, ...], risk: float, doubt: float) -> T | None:
    """The strictest cutoff, or joint setting, of the sequence that is certified, None if none is."""
    best = None
    for k, cutoff in zip(rejected, cutoffs, strict=True):
        if k > risk * n or binomial_tail(k, n, risk) > doubt:
            break
        best = cutoff
    return best


def least_labels(risk: float, doubt: float) -> int:
    """How many good documents without a false rejection certify a setting."""
    n = max(1, math.floor(math.log(doubt) / math.log1p(-risk)))
    return n if binomial_tail(0, n, risk) <= doubt else n + 1


def thresholds(measured: DataFrame, labels: DataFrame, risk: float, doubt: float) -> DataFrame:
    """(stratum, one cutoff or null per rule) from the labelled good documents.

    `measured` has doc_id, stratum and a column per measure of CUTOFFS.
    """
    good = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .where(F.col("quality") == 1)
        .select("doc_id")
    )
    steps = [f"step_{i}" for i in range(len(SETTINGS))]
    rejected = [
        F.count_if(reduce(or_, [F.col(rule) > c for rule, c in setting.items()])).alias(step)
        for step, setting in zip(steps, SETTINGS, strict=True)
    ]
    held_out = materialised(
        measured.join(good, "doc_id", "left_semi")
        .groupBy("doc_id", "stratum")
        .agg(*[F.max(rule).alias(rule) for rule in CUTOFFS])
        .groupBy("stratum")
        .agg(F.count(F.lit(1)).alias("n"), *rejected)
    )
    tests, enough = tested_strata(held_out, risk, doubt)

    def certify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            best = [
                certified(list(k), n, SETTINGS, risk, doubt / tests) or {}
                for k, n in zip(frame[steps].to_numpy(), frame["n"], strict=True)
            ]
            out = pd.DataFrame({"stratum": frame["stratum"]})
            for rule in CUTOFFS:
                out[rule] = pd.Series([b.get(rule, math.inf) for b in best], dtype="float64")
            yield out

    schema = "stratum string, " + ", ".join(f"{rule} double" for rule in CUTOFFS)
    found = held_out.where(F.col("n") >= enough).mapInPandas(certify, schema)
    cutoffs = [F.when(F.col(rule) < math.inf, F.col(rule)).alias(rule) for rule in CUTOFFS]
    return found.select("stratum", *cutoffs)


def tested_strata(held_out: DataFrame, risk: float, doubt: float) -> tuple[int, int]:
    """How many tests share the doubt, and the least `n` of a stratum that is tested.

    The fewest tests are taken such that no more strata than that have enough labels at
    their share of the doubt. Sizes reach the driver as a histogram, cut off where the
    size no longer matters: about log(strata) / risk numbers.
    """
    most = max(1, held_out.count())
    sizes = held_out.groupBy(F.least("n", F.lit(least_labels(risk, doubt / most))).alias("n")).count().collect()

    def too_many(tests: int) -> bool:
        enough = least_labels(risk, doubt / tests)
        return sum(row["count"] for row in sizes if row["n"] >= enough) > tests

    tests = bisect_left(range(1, most), True, key=lambda k: not too_many(k)) + 1
    return tests, least_labels(risk, doubt / tests)


def _stratum() -> Column:
    return F.coalesce(F.concat(F.lit("lang "), F.col("lang")), F.lit("none"))


def learn_thresholds(counted: DataFrame, labels: DataFrame, risk: float, doubt: float) -> DataFrame:
    """Thresholds from all labelled documents of `counted` (doc_id, lang, `__counts`)."""
    measures = [c.alias(k) for k, c in _measures().items()]
    return thresholds(counted.select("doc_id", _stratum().alias("stratum"), *measures), labels, risk, doubt)


def stored_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, `__counts`) of every row, stored without the texts."""
    return materialised(with_counts(docs.select("doc_id", "text", "lang")).drop("text"))


def judged(counted: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """`counted` (see `with_counts`) with booleans `__base_failed` and `__kept`."""
    named = materialised(cutoffs).select(
        F.col("stratum").alias("__stratum"), *[F.col(rule).alias(f"__{rule}") for rule in CUTOFFS]
    )
    over = F.lit(False)
    for rule, measure in _measures().items():
        over = over | F.coalesce(measure > F.col(f"__{rule}"), F.lit(False))
    return (
        counted.withColumn("__of", _stratum())
        .join(if_small(named, MOST_BROADCAST), F.col("__of") == F.col("__stratum"), "left")
        .withColumn("__base_failed", base_failed())
        .withColumn("__kept", ~F.col("__base_failed") & ~over)
        .drop("__of", "__stratum", *[f"__{rule}" for rule in CUTOFFS])
    )


def keep_good(docs: DataFrame, labels: DataFrame, risk: float, doubt: float) -> DataFrame:
    """The documents that pass the base rule and every certified threshold.

    Texts are measured twice and never shuffled: labels meet the stored counts only.
    """
    cutoffs = learn_thresholds(stored_counts(docs), labels, risk, doubt)
    return judged(with_counts(docs), cutoffs).where("__kept").select(*docs.columns)


def verdicts(docs: DataFrame, labels: DataFrame, risk: float, doubt: float) -> DataFrame:
    """doc_id, counts, base_failed and kept, measuring each text once."""
    counted = stored_counts(docs)
    return judged(counted, learn_thresholds(counted, labels, risk, doubt)).select(
        "doc_id",
        *[F.col(f"__counts.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("__base_failed").alias("base_failed"),
        F.col("__kept").alias("kept"),
    )
