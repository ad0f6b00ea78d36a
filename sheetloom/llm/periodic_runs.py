"""Operator 12: runs of repeated words, found as Kolpakov and Kucherov do.

A run is a stretch of words with smallest period q, at least LEAST words and two periods long,
that no neighbouring word extends. The words are cut into the factors of Lempel and Ziv: the
longest piece that also starts further left, or one new word. A suffix automaton of the words,
with the place where each of its states first ends, gives these factors and their earlier places.
A run either touches a border between factors, and then reaches less than twice the factor before
it and once the one behind it to the left: Main's algorithm finds these from the longest common
extensions around the border. Or it lies within one factor, and then it is copied from that
factor's earlier place. All is linear in the number of words.

Every word of a run is in a sequence of LEAST / 2 words that the run, and so the text, holds
twice. So the automaton is only built for the stretches that such sequences cover; they are found
by hashes for a whole batch. A stretch holds whole runs, and no run reaches its neighbours. Words
compare by hashes of 64 bits: two words of one text have equal ones by chance in 1 of 10**11
texts of ten thousand different words.
"""

from __future__ import annotations

from array import array
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Words, each_chunk, mix

#: Least length of a run in words.
LEAST = 12


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """(begin, length, earlier begin or -1) of the Lempel-Ziv factors; an earlier piece may overlap the factor."""
    # states of the suffix automaton: longest word, suffix link, first end, and transitions: one in two arrays, more in dicts
    longest, link, end = array("i", [0]), array("i", [-1]), array("i", [-1])
    letter, target = array("i", [-1]), array("i", [-1])
    more: dict[int, dict[int, int]] = {}
    none: dict[int, int] = {}
    last = 0
    for i, c in enumerate(w):
        new = len(longest)
        longest.append(longest[last] + 1)
        link.append(0)
        end.append(i)
        letter.append(-1)
        target.append(-1)
        p, last = last, new
        q = -1
        while p >= 0:
            q = target[p] if letter[p] == c else more.get(p, none).get(c, -1)
            if q >= 0:
                break
            if letter[p] < 0:
                letter[p], target[p] = c, new
            else:
                more.setdefault(p, {})[c] = new
            p = link[p]
        if q < 0:
            continue
        if longest[q] == longest[p] + 1:
            link[new] = q
            continue
        clone = len(longest)
        longest.append(longest[p] + 1)
        link.append(link[q])
        end.append(end[q])
        letter.append(letter[q])
        target.append(target[q])
        if q in more:
            more[clone] = dict(more[q])
        while p >= 0:
            if letter[p] == c:
                if target[p] != q:
                    break
                target[p] = clone
            elif more.get(p, none).get(c, -1) == q:
                more[p][c] = clone
            else:
                break
            p = link[p]
        link[q] = link[new] = clone
    out, at, n = [], 0, len(w)
    while at < n:
        state, size = 0, 0
        while at + size < n:
            c = w[at + size]
            to = target[state] if letter[state] == c else more.get(state, none).get(c, -1)
            if end[to] >= at + size:  # ends here for the first time
                break
            state, size = to, size + 1
        out.append((at, size, end[state] - size + 1) if size else (at, 1, -1))
        at += max(size, 1)
    return out


def extensions(w: list[int]) -> list[int]:
    """How far the words from each place on agree with the first ones (0 at the first place)."""
    n, left, right = len(w), 0, 0
    z = [0] * n
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and w[k] == w[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def at_border(w: list[int], border: int, before: int, size: int) -> dict[tuple[int, int], int]:
    """(begin, end) -> period of the runs that touch `border` and end in the `size` words behind it; `before` words count to its left."""
    u, v = w[border : border + size], w[max(0, border - before) : border]
    m, n = len(u), len(v)
    ahead = extensions([*u, -1, *v, *u])
    back = extensions([*v[::-1], -1, *u[::-1], *v[::-1]])
    found: dict[tuple[int, int], int] = {}

    def note(begin: int, stop: int, q: int) -> None:
        if stop - begin >= LEAST and (not begin or w[begin - 1] != w[begin - 1 + q]) and (stop == len(w) or w[stop] != w[stop - q]):
            found[begin, stop] = min(q, found.get((begin, stop), q))

    for q in range(1, m + 1):  # the words q behind the border against those at it
        right, left = ahead[q] if q < m else 0, back[n + 1 + m - q]
        if left + right >= q:
            note(border - left, border + q + right, q)
    for q in range(1, n + 1):  # the words at the border against those q before it
        right, left = ahead[m + 1 + n - q], back[q] if q < n else 0
        if left + right >= q:
            note(border - q - left, border + right, q)
    return found


def runs(w: list[int]) -> list[tuple[int, int, int]]:
    """(begin, length, period) of all runs of at least LEAST words, by begin, then period."""
    of: dict[tuple[int, int], int] = {}
    ends: dict[int, list[int]] = {}  # by begin

    def add(begin: int, stop: int, q: int) -> None:
        if (begin, stop) not in of:
            of[begin, stop] = q
            insort(ends.setdefault(begin, []), stop)

    before = 0
    for begin, size, source in [*factors(w), (len(w), 0, -1)]:
        if begin and 2 * (before + size) >= LEAST:
            for (a, b), q in at_border(w, begin, 2 * before + size, size).items():
                add(a, b, q)
        # runs within the factor; those of a factor that overlaps its source are copied on from copies
        step = begin - source
        for a in range(source + 1, source + size - LEAST) if source >= 0 else ():
            for b in ends.get(a, ()):
                if b < source + size:
                    add(a + step, b + step, of[a, b])
        before = size
    return sorted((a, b - a, q) for (a, b), q in of.items())


def stretches(h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, begin, end) of the stretches of LEAST words and more, covered by sequences of LEAST / 2 words that their text holds twice."""
    width = LEAST // 2
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    use = np.flatnonzero(np.arange(len(h)) + width <= first[of + 1]) if len(h) else np.zeros(0, np.int64)
    if not len(use):
        return []
    key = mix(of[use].astype(np.uint64))
    for k in range(width):
        key = mix(key ^ h[use + k])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(use), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int32)
    cover[use[twice]] += 1
    cover[use[twice] + width] -= 1
    covered = np.cumsum(cover)[:-1] > 0
    change = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    # a text's last words and the next one's first ones may both be covered
    out = []
    for a, b in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
        for t in range(of[a], of[b - 1] + 1):
            lo, hi = max(a, int(first[t])), min(b, int(first[t + 1]))
            if hi - lo >= LEAST:
                out.append((t, lo, hi))
    return out


def _find(batch: pa.RecordBatch, words: Words) -> list:
    h, found = words.hashes(), [[] for _ in range(words.texts)]
    kept = np.ones(len(h), bool)
    for t, lo, hi in stretches(h, words.first):
        _, w = np.unique(h[lo:hi], return_inverse=True)
        for a, size, q in runs(w.tolist()):
            found[t].append({"start": lo - int(words.first[t]) + a, "length": size, "period": q})
            kept[lo + a + q : lo + a + size] = False
    data, texts = words.data.tobytes(), []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if kept[a:b].all():
            lo, hi = (words.start[a], words.end[b - 1]) if a < b else (0, 0)
            texts.append(b" ".join(data[lo:hi].split()))
        else:
            texts.append(b" ".join([data[words.start[k] : words.end[k]] for k in np.flatnonzero(kept[a:b]) + a]))
    return [batch.column(0), found, pa.array(texts, pa.binary()).cast(pa.string())]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period of each, by start, then period), collapsed of every row.

    start counts words from 0. collapsed holds the words, joined by one blank, without those that a run contains
    after its first period. Null and empty texts have no runs and collapse to ''. One result for
    each input row, repeated rows and rows of null doc_id too; nothing is shuffled. Very long
    texts are read whole, in time and memory that grow with their length. Other columns are
    ignored; an empty table gives no rows.
    """
    run = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct(run))), ("collapsed", pa.string())])
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(each_chunk(schema, _find), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period), and digests of all runs and of the collapsed text."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("top", top)
    start, length, period = -F.col("top.start"), F.col("top.length"), -F.col("top.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_periods(docs: DataFrame) -> DataFrame:
    """`docs` with a periodic end in the texts of one id in ten, by the checksum of the id.

    With h = crc32 of the decimal doc_id and g = h div 10, where h is divisible by 10, each of the
    n words from a = g mod n on is replaced by the one at a + (i - a) mod p, p = 1 + (n - a) div
    (3 + g mod 8). Rows of null doc_id stay as they are.
    """

    def changed(words: Column, g: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.array_join(F.transform(at, lambda i: F.get(words, i.cast("int"))), " ")

    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    words = F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    chosen = (h % 10 == 0) & F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # each worked out once: bound to the names of a one-element transform
    text = F.get(F.transform(F.array(F.struct(words.alias("w"), F.floor(h / 10).alias("g"))), lambda x: changed(x["w"], x["g"])), F.lit(0))
    return docs.select("doc_id", F.when(chosen, text).otherwise(F.col("text").cast("string")).alias("text"))
