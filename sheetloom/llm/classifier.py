"""Operator 7: a quality classifier learnt from trusted positives and unlabelled text.

The risk of a scorer g is estimated without negatives: pi * E_p[l(g, +1)] plus the part of the
negatives, E_u[l(g, -1)] - pi * E_p[l(g, -1)], which is held at zero or above. With the squared
loss and a model that is linear in its features, every term is a quadratic form of first and
second moments. So one pass over all documents gathers the moments (a table of a few thousand
numbers, whatever the input), and the risk is minimised on them exactly, on the driver.

Features are statistics of a text put into bins, each bin a 0/1 input, so the model is a sum of
step functions. The squared-loss minimiser is 2 * P[label 1 | text] - 1, which gives the score.

The class prior pi is estimated from positives and unlabelled text alone. Wherever text is
looked at, at least pi times the positives' share of that place is unlabelled text there; and
where nearly all text is positive, it is no more. So pi is the least ratio of the two shares
over the places "density ratio above c", with the ratio of densities fitted by least squares on
the same moments. How the labels were drawn among good and bad documents doesn't matter to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import settle
from .words import each_text

#: Statistics and the upper edges of their bins but the last.
EDGES = {
    "words": (0, 5, 10, 20, 35, 50, 100, 200, 400, 1000, 3000),
    "word_length": (2.5, 3.5, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 15),
    "capitals": (0.002, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.4, 0.7),
    "symbols": (0, 0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.5, 1),
    "pipes": (0, 0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4),
    "bangs": (0, 0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.5),
    "digits": (0, 0.001, 0.003, 0.01, 0.02, 0.05, 0.1, 0.3),
    "distinct": (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "dup_lines": (0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.8),
    "line_words": (1.5, 3, 6, 10, 20, 40, 80, 160),
    "stops": (0, 0.01, 0.03, 0.05, 0.07, 0.1, 0.15),
    "pairs": (0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 0.9, 0.97),
}
OFFSETS = dict(zip(EDGES, np.cumsum([0] + [len(e) + 1 for e in EDGES.values()]).tolist(), strict=False))
WIDTH = sum(len(e) + 1 for e in EDGES.values())
RIDGE = 1e-4
THRESHOLD = 0.3
#: Places that the prior's estimate looks at; positives it needs; share of the positives in a place at least.
PLACES, PRIOR_LEAST, PRIOR_SHARE = 1000, 50, 0.25
_CAPITALS, _DIGITS = bytes(range(65, 91)), b"0123456789"


def bins(text: str) -> tuple[list[int]]:
    """The input that is 1 in each group of inputs, in the order of EDGES."""
    raw = text.encode()
    words = raw.split()
    n = len(words) or 1
    chars = sum(map(len, words)) or 1
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    values = (
        len(words),
        chars / n,
        (len(raw) - len(raw.translate(None, _CAPITALS))) / chars,
        sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"<", b">"))) / n,
        raw.count(b"|") / n,
        raw.count(b"!") / n,
        (len(raw) - len(raw.translate(None, _DIGITS))) / chars,
        len(set(words)) / n,
        (len(lines) - len(set(lines))) / (len(lines) or 1),
        len(words) / (len(lines) or 1),
        (raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")) / n,
        len(set(zip(words, words[1:], strict=False))) / n,
    )
    return ([OFFSETS[name] + int(np.searchsorted(edges, v)) for (name, edges), v in zip(EDGES.items(), values, strict=True)],)


def features(docs: DataFrame) -> DataFrame:
    """doc_id and bins of every row; labels, lang, source and doc_id are no inputs."""
    schema = pa.schema([("doc_id", pa.int64()), ("bins", pa.list_(pa.int16()))])
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(each_text(schema, bins), "doc_id long, bins array<smallint>")


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of `rows` (bins, positive) by pairs of inputs that are 1 together: of all rows, of the positives."""
    pairs = rows.select("positive", F.explode("bins").alias("i"), "bins").select("positive", "i", F.explode("bins").alias("j"))
    counts = pairs.groupBy("i", "j").agg(F.count("*").alias("u"), F.count(F.when(F.col("positive"), 1)).alias("p")).toPandas()  # WIDTH squared at most
    u, p = np.zeros((WIDTH, WIDTH)), np.zeros((WIDTH, WIDTH))
    u[counts["i"], counts["j"]], p[counts["i"], counts["j"]] = counts["u"], counts["p"]
    return u, p


def minimise(u: np.ndarray, p: np.ndarray, prior: float, rounds: int = 500) -> np.ndarray:
    """Weights of least non-negative risk, from second moments of the unlabelled and the positives.

    Inputs are groups of 0/1, one 1 in each group, so first moments are sums within the second.
    """
    groups = len(EDGES)
    nu, np_ = max(np.trace(u) / groups, 1.0), max(np.trace(p) / groups, 1.0)
    mu, mp = np.diag(u) / nu, np.diag(p) / np_
    u, p = u / nu, p / np_
    eye = RIDGE * np.eye(WIDTH)
    # pi E_p[(1-g)^2] + E_u[(1+g)^2] - pi E_p[(1+g)^2], over 4: its least point in closed form
    w = np.linalg.solve(u + eye, 2 * prior * mp - mu)

    def negative(w: np.ndarray) -> float:
        return (1 + 2 * w @ mu + w @ u @ w) / 4 - prior * (1 + 2 * w @ mp + w @ p @ w) / 4

    step = 1 / np.linalg.eigvalsh(u + p + eye).max()
    for _ in range(rounds):
        if negative(w) >= 0:
            break
        # below zero the estimate overfits: go back up along its own gradient
        w = w + step * ((mu + u @ w) / 2 - prior * (mp + p @ w) / 2)
    return w


def linear(w: np.ndarray) -> Column:
    """The sum of a row's weights."""
    return F.aggregate("bins", F.lit(0.0), lambda s, b: s + F.element_at(F.lit([float(x) for x in w]), b.cast("int") + 1))


def score(w: np.ndarray) -> Column:
    """The score of a row from its bins."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (linear(w) + 1) / 2))


def density_ratio(u: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Weights of the density of positives over that of all text, by least squares."""
    groups = len(EDGES)
    nu, np_ = max(np.trace(u) / groups, 1.0), max(np.trace(p) / groups, 1.0)
    return np.linalg.solve(u / nu + RIDGE * np.eye(WIDTH), np.diag(p) / np_)


def least_ratio(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """The prior from counts by place, in order of a rising density ratio.

    The ratio of the shares above a place, with the bounds (Hoeffding, 95 %) of what sampling
    can do to the positives' share; places with less than PRIOR_SHARE of them are too small.
    """
    above = np.cumsum(unlabelled[::-1]) / unlabelled.sum(), np.cumsum(positive[::-1]) / positive.sum()
    use = above[1] >= PRIOR_SHARE
    slack = np.sqrt(np.log(20) / (2 * positive.sum()))
    return float(min(1.0, (above[0][use] / np.maximum(above[1][use] - slack, PRIOR_SHARE / 2)).min()))


def estimated_prior(rows: DataFrame, u: np.ndarray, p: np.ndarray) -> float:
    """The share of label 1 in all text; `rows` are (bins, positive)."""
    r = F.greatest(linear(density_ratio(u, p)), F.lit(0.0))
    place = F.floor(r / (r + 1) * PLACES).cast("int")
    counts = rows.groupBy(place.alias("place")).agg(F.count("*").alias("u"), F.count_if("positive").alias("p")).toPandas()  # at most PLACES rows
    by = np.zeros((2, PLACES + 1))
    by[:, counts["place"]] = counts["u"], counts["p"]
    return least_ratio(*by)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Learns from the labels 1 of rows whose crc32 of the id as text is not 0 modulo 5, the trusted
    positives. All documents are the unlabelled text, and the class prior is estimated from
    both. With fewer than PRIOR_LEAST positives the prior falls back to the share of 1 among the
    labels; without positives every score is that share (1 if there are no labels at all). A
    document labelled more than once counts with its highest label; null labels and labels
    without a document are ignored. Null and empty texts are scored like others, with all counts
    0, and very long ones are read whole; repeated rows get one result each; a null id is never
    held out. Other columns are ignored; an empty table gives no rows.
    """
    found = settle(features(docs))
    known = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "quality",
    ).where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    known = settle(known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")))
    share = known.agg(F.avg("quality").alias("prior"), F.sum("quality").alias("n"), F.count("*").alias("rows")).first()
    prior = 1.0 if share["prior"] is None else min(1 - 1e-3, max(1e-3, share["prior"]))
    positives = known.where("quality = 1").select("doc_id", F.lit(True).alias("positive"))
    if share["n"]:
        rows = found.join(positives, "doc_id", "left").select("bins", F.coalesce("positive", F.lit(False)).alias("positive"))
        u, p = moments(rows)
        if np.trace(p) / len(EDGES) >= PRIOR_LEAST:
            prior = min(1 - 1e-3, max(1e-3, estimated_prior(rows, u, p)))
        how = score(minimise(u, p, prior))
    else:
        how = F.lit(prior)
    out = found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), how.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
