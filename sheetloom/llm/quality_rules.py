"""Operator 2: quality rules whose cutoffs carry a proven limit on false rejection.

Rules reject a document when a statistic of its text is above the rule's cutoff. The cutoffs of
all rules move together along one path that is fixed beforehand: from loose ones, by equal
factors, down to FLOORS. So a document is rejected from some step of the path on, and a step is
all that has to be kept of it.

How far down a stratum (language) may go is decided by its documents labelled good, as a
holdout. A step that rejects k of n good documents is certified when so few rejections would be
unlikely if the true rate of false rejection were above `alpha`: P[Bin(n, alpha) <= k] is at
most the level, which is the exact (Clopper-Pearson) upper bound put as a test. Steps are tested
from the loosest on and testing stops at the first failure, so those of one stratum need no
correction among themselves: a false certificate needs the first step that is truly too tight
to pass, which has the probability of the level. Strata share delta equally (Bonferroni).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import settle
from .words import each_text

#: Rules: statistic of a document, as an SQL expression over the metrics, and its tightest cutoff.
RULES = {
    "symbols": ("n_symbols / n_words", 0.1),
    "dup_lines": ("n_dup_lines / n_lines", 0.3),
    "repeats": ("n_repeat_words / n_words", 0.3),
    "capitals": ("n_capitals / word_chars", 0.3),
    "bangs": ("n_bangs / n_words", 0.1),
}
#: Steps of the path, and steps in which the cutoffs double; at step 0 they are the tightest ones.
STEPS, DOUBLING = 64, 8
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_CAPITALS = bytes(range(65, 91))


def measure(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_bangs."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return (0,) * 8
    seen, dup, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    # 3-word windows by number: equal numbers are equal windows
    ids: dict = {}
    numbers = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    repeat = 0
    if len(words) > 3:
        k = np.int64(len(ids))
        pair = np.unique(numbers[:-2] * k + numbers[1:-1], return_inverse=True)[1]
        _, at, n = np.unique(pair * k + numbers[2:], return_inverse=True, return_counts=True)
        again = n[at] > 1
        if again.any():
            covered = np.zeros(len(words), bool)
            for d in range(3):
                covered[d : d + len(again)] |= again
            repeat = int(covered.sum())
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, _SYMBOLS)),
        dup,
        repeat,
        lines,
        len(raw) - len(raw.translate(None, _CAPITALS)),
        text.count("!"),
    )


_METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_bangs")


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the metrics of every row; a null text has no words."""
    schema = pa.schema([("doc_id", pa.int64()), ("stratum", pa.string()), *((m, pa.int64()) for m in _METRICS)])
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"),
        F.col("text").cast("string").alias("text"),
    )
    out = plain.mapInArrow(
        each_text(schema, measure, keep=("doc_id", "stratum")),
        "doc_id long, stratum string, " + ", ".join(f"{m} long" for m in _METRICS),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P[Bin(n, p) <= k], exactly but for rounding."""
    if k >= n:
        return 1.0
    i = np.arange(0, k + 1)
    lg = np.array([math.lgamma(x + 1) for x in i]) + np.array([math.lgamma(n - x + 1) for x in i])
    terms = math.lgamma(n + 1) - lg + i * math.log(p) + (n - i) * math.log1p(-p)
    top = terms.max()
    return float(min(1.0, math.exp(top) * np.exp(terms - top).sum()))


def certified(counts: dict[int, int], alpha: float, level: float) -> int | None:
    """The tightest step that fixed-sequence testing certifies, or None.

    `counts` has the number of good documents for each step, the last one that keeps them.
    """
    n = sum(counts.values())
    found, above = None, sum(c for s, c in counts.items() if s > STEPS)
    for step in range(STEPS, -1, -1):  # rejected: documents of a step above
        if above > n * alpha or binomial_cdf(above, n, alpha) > level:
            break
        found = step
        above += counts.get(step, 0)
    return found


def step() -> Column:
    """The tightest step of the path whose cutoffs all let a document pass, STEPS + 1 if none does."""
    steps = [F.expr(f"case when {e} > {floor} then ceil({DOUBLING} * log2(({e}) / {floor})) else 0 end") for e, floor in RULES.values()]
    return F.least(F.greatest(*steps), F.lit(STEPS + 1)).cast("long")


def cutoffs(good: DataFrame, alpha: float, delta: float) -> DataFrame:
    """stratum, cutoff (a step): `good` has stratum, step, n: at most strata x (STEPS + 2) rows, counts only."""
    strata = good.agg(F.count_distinct("stratum").alias("m")).first()["m"]

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        found = certified(dict(zip(pdf["step"].tolist(), pdf["n"].tolist(), strict=True)), alpha, delta / strata)
        return pd.DataFrame([] if found is None else [(pdf["stratum"].iloc[0], found)], columns=["stratum", "cutoff"]).astype({"cutoff": "int64"})

    return good.groupBy("stratum").applyInPandas(test, "stratum string, cutoff long")


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """A verdict for every document: the metrics, base_failed, kept. Columns but doc_id, text and lang are ignored.

    With probability 1 - delta, no stratum loses more than `alpha` of its good documents that
    pass the base rules to all other rules taken together. A stratum with too few labels gets no cutoff and only
    the base rules: it takes log(delta / strata) / log(1 - alpha) good labels, 86 for four
    strata. `labels` (doc_id, quality) may repeat rows; a document with any label 1 counts as
    good, null labels don't count, and labels without a document are ignored. Documents of null
    language form a stratum of their own. Rows are kept as they are: one result for each input
    row, repeated rows included. A null or empty text has no words and fails the base rules; a
    very long one is measured whole. No labels or no documents: no cutoffs.
    """
    found = settle(metrics(docs).withColumn("step", F.when(~F.col("base_failed"), step())))
    marked = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = settle(found.where("not base_failed").join(marked, "doc_id", "left_semi").groupBy("stratum", "step").agg(F.count("*").alias("n")))
    out = found.join(settle(cutoffs(good, alpha, delta)), "stratum", "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("step") <= F.col("cutoff"), F.lit(True))
    return out.withColumn("kept", kept).select("doc_id", *_METRICS, "base_failed", "kept", "stratum")
