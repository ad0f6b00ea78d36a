"""Runs held against brute force over all periods."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sheetloom.llm import periodic_runs


def plain_runs(w, least=periodic_runs.LEAST):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j + q), q)  # the smallest period first
            i = max(j, i) + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def strings(kind, r):
    if kind == "random":
        return [r.randrange(r.choice([1, 2, 2, 3, 4])) for _ in range(r.randrange(0, 70))]
    if kind == "repeats":
        out = []
        while len(out) < 90:
            piece = [r.randrange(3) for _ in range(r.randrange(1, 12))]
            out += piece * r.choice([1, 1, 2, 3, 5])
        return out
    if kind == "nested":  # a repeated piece that holds runs itself
        piece = [r.randrange(2) for _ in range(r.randrange(1, 4))] * r.randrange(3, 9) + [7] * r.randrange(2)
        middle = [r.randrange(9) for _ in range(r.randrange(0, 6))]
        return (piece + middle) * r.randrange(1, 5) + piece[: r.randrange(len(piece))]
    a, b = [0], [0, 1]  # Fibonacci words have the most runs
    for _ in range(r.randrange(5, 9)):
        a, b = b, b + a
    return b[r.randrange(5) :]


@pytest.mark.parametrize("kind", ["random", "repeats", "nested", "fibonacci"])
def test_runs_match_brute_force(kind):
    r = random.Random(kind)
    for _ in range(1500 if kind != "fibonacci" else 60):
        w = strings(kind, r)
        assert periodic_runs.runs(w) == plain_runs(w), w


def test_factors_are_longest_earlier_pieces():
    r = random.Random(8)
    for _ in range(300):
        w = strings("random", r)
        at = 0
        for begin, size, source in periodic_runs.factors(w):
            assert begin == at
            earlier = [max((k for k in range(len(w) - at + 1) if w[s : s + k] == w[at : at + k]), default=0) for s in range(at)]
            assert size == max([1, *earlier])
            assert source == -1 and not max([0, *earlier]) or w[source : source + size] == w[at : at + size] and 0 <= source < at
            at += size
        assert at == len(w)


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for a, size, q in found for i in range(a + q, a + size)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
    return (
        doc_id,
        len(found),
        *best,
        1000 * best[1] // best[2] if found else None,
        hashlib.sha256("".join(f"{a},{s},{q}\n" for a, s, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_query_matches_brute_force(spark):
    r = random.Random(6)
    rows = [(k, " ".join(f"w{x}é" for x in strings(r.choice(["random", "repeats", "nested"]), r))) for k in range(150)]
    rows += [(k, " ".join(f"u{r.randrange(400)}" for _ in range(r.randrange(200)))) for k in range(150, 260)]
    rows += [(300, None), (301, ""), (302, " \n"), (None, "a b " * 9), (303, "x y  z\n" * 7), (3, rows[3][1]), (None, None)]
    rows += [(k, f"same end {'p q r ' * 5}") for k in (400, 401)] + [(k, "p q r " * 6) for k in (402, 403)]  # neighbours in a batch
    docs = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "doc_id long, text string, runs int, top int, start int")
    got = periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.with_periods(docs)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda x: tuple(-1 if v is None else v for v in x[:2]) + tuple(x[6:])
    assert sorted((tuple(x) for x in got.collect()), key=key) == sorted((plain_row(*x) for x in rows), key=key)
    assert got.where(F.lit(False)).count() == 0


def test_long_periodic_text(spark):
    r = random.Random(1)
    piece = [f"w{r.randrange(60)}" for _ in range(7000)]
    docs = spark.createDataFrame([(1, " ".join(piece * 4))], "doc_id long, text string")
    runs = periodic_runs.periodic_runs(docs).first()["runs"]
    assert (0, 28000, 7000) in [tuple(x) for x in runs]
