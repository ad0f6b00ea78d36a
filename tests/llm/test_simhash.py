"""SimHash and its trie join, held against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sheetloom.llm import simhash
from sheetloom.llm.words import Words, chunks


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and blanks are those of the contract
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """rows: (doc_id, fingerprint); smallest doc_id reachable of each."""
    over = {d: d for d, _ in rows if d is not None}

    def top(k):
        while over[k] != k:
            k = over[k]
        return k

    for d, f in rows:
        for e, g in rows:
            if d is not None and e is not None and (f ^ g).bit_count() <= 2:
                p, q = top(d), top(e)
                over[max(p, q)] = min(p, q)
    return {d: top(d) for d in over}


def test_fingerprints_match_brute_force():
    r = random.Random(2)
    texts = [None, "", " \t", "One", "one  two", "É é\nZ", "a a a a a a a"] + [
        "".join(r.choice(["Ab", "c", "ß", "É", " ", " ", "\n", "\t ", "x"]) for _ in range(r.randint(0, 60))) for _ in range(300)
    ] + [" ".join(f"w{r.randrange(50)}" for _ in range(20000))]
    got = np.concatenate([simhash.fingerprint(Words(d, o, lower=True)) for _, _, d, o in chunks(pa.array(texts, pa.string()), 1000)])
    assert got.tolist() == [plain_fingerprint(t) for t in texts]


def test_hashes_are_those_of_spark(spark):
    row = spark.sql("select xxhash64('one two three') as h").first()
    assert row["h"] % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


@pytest.mark.parametrize("bits", [6, 10, 64])
def test_close_pairs_match_brute_force(bits):
    r = random.Random(bits)
    top = 0xABCDEF0123456789 >> bits << bits if bits < 64 else 0
    values = sorted({top | r.getrandbits(bits) for _ in range(150)} | {top, top | 3, top | 1})
    values = sorted(set(values) | {v ^ (1 << r.randrange(bits)) for v in values})
    x = np.array(values, np.uint64)
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if (values[i] ^ values[j]).bit_count() <= 2}
    i, j = simhash.close_pairs(x, None)
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want
    half = top | 1 << (bits - 1)
    lo, hi = x[x < half], x[x >= half]
    i, j = simhash.close_pairs(lo, hi, 65 - bits if bits < 64 else 1)
    want = {(p, q) for p, a in enumerate(lo.tolist()) for q, b in enumerate(hi.tolist()) if (a ^ b).bit_count() <= 2}
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_trie_join_matches_brute_force_at_every_group_size(spark):
    """A dense ball, a long common prefix and far values; small groups send the traversal down to the leaves."""
    r = random.Random(9)
    ball = {(1 << 63) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(120)}
    deep = {0x1234567890ABCD00 | r.getrandbits(8) for _ in range(90)}
    far = {r.getrandbits(64) for _ in range(150)}
    values = sorted(ball | deep | far | {v ^ 5 for v in list(far)[:40]} | {0, 1, (1 << 64) - 1})
    want = plain_components([(v, v) for v in values])
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    for group in (8, 10_000):
        over = dict(zip(values, values, strict=True))

        def top(k):
            while over[k] != k:
                k = over[k]
            return k

        for a, b in simhash.close_links(fps, group).collect():
            a, b = a % (1 << 64), b % (1 << 64)
            assert (a ^ b).bit_count() <= 2
            p, q = top(a), top(b)
            over[max(p, q)] = min(p, q)
        assert {v: top(v) for v in values} == want


def test_node_pairs_hold_each_close_pair_once(spark):
    r = random.Random(3)
    values = sorted({r.getrandbits(12) << 52 | r.getrandbits(3) for _ in range(300)})
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    pairs = [(d, a % (1 << 64), b % (1 << 64)) for d, a, b in simhash.node_pairs(fps, 16).collect()]
    for k, v in enumerate(values):
        for w in values[k + 1 :]:
            if (v ^ w).bit_count() <= 2:
                assert sum({a, b} == {v >> (64 - d), w >> (64 - d)} for d, a, b in pairs) == 1


def test_operator_matches_brute_force(spark):
    r = random.Random(5)
    base = " ".join(f"w{r.randrange(400)}" for _ in range(300))
    rows = [(k, base) for k in (7, 3, 50)]
    for k in range(100, 160):  # near copies: one word less or more
        words = base.split()
        words[r.randrange(len(words))] = "edited"
        rows.append((k, " ".join(words)))
    rows += [(k, " ".join(f"v{r.randrange(90)}" for _ in range(r.randrange(0, 9)))) for k in range(200, 280)]
    rows += [(300, None), (301, ""), (302, " \n"), (None, base), (None, None), (303, "long " * 30000), (7, base), (304, "other text here now"), (304, base)]
    docs = spark.createDataFrame([(*x, 1, 2, 3, 4, 5) for x in rows], "doc_id long, text string, fp int, rep int, component int, leaf int, node int")
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    want = plain_components(prints)
    for group in (40, simhash.GROUP):
        got = simhash.simhash_duplicates(docs, group).collect()
        assert sorted((x.doc_id or -1, x.fingerprint, x.component_id or -1) for x in got) == sorted(
            (d or -1, f"{f:016x}", -1 if d is None else want[d]) for d, f in prints
        )
    assert simhash.simhash_duplicates(docs.where(F.lit(False))).count() == 0
