"""Operator 4: near-duplicates by bottom-k sketches of five-word shingles.

Every document keeps the K smallest hashes of its shingles, from one hash function. Two
documents of similarity 0.75 have many retained values in common: all of `need` values for sets
that are kept whole, and LEAST of K for larger ones but for a chance of 1 in ten million
at exactly 0.75. So if all documents put their retained values in one order and leave out the last
need - 1 of them, any two such documents still have a value in common. The order is by the
number of documents that hold a value, rarest first: values of widespread passages come last
and are left out, and values that one document holds alone need no list at all.

Equal sets are one node from the start. Each inverted list first links its members to its hub,
the member with the fewest values of its own: an original has none, its edited copies have some.
Members of a list that are then still in different components are compared within the list, block
by block: first by the common values of their sketches, then on the full sets, and of the links
found only those that join components are told. All links are confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import settle
from .words import Words, each_chunk

SHINGLE, K = 5, 64
#: Similarity of 75 %, in whole numbers.
PART, WHOLE = 75, 100
#: Common values of two sketches that aren't whole sets: P[Bin(64, 0.75) < 29] is 1 in ten million.
LEAST = 29
#: Sets of up to so many values have only partners that are kept whole, too.
SURE = K * PART // WHOLE
#: Members of a list compared in one task and their shingles, about; longer lists are compared block by block.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
#: Values counted at once, and pairs for each member from which counting all pairs at once is cheaper.
COLUMNS, DENSE = 4096, 16


def shingle_sets(words: Words) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, as 63-bit numbers."""
    first = words.first
    n = np.diff(first)
    length = np.minimum(n, SHINGLE)
    starts = np.arange(len(words.start))
    of = np.repeat(np.arange(words.texts), n)
    starts = starts[starts <= first[of + 1] - length[of]] if len(starts) else starts
    h = words.windows(
        starts,
        length[np.repeat(np.arange(words.texts), np.where(n > 0, n - length + 1, 0))],
    ) if len(starts) else np.zeros(0, np.uint64)
    h = (h >> np.uint64(1)).view(np.int64)
    ends = np.cumsum(np.where(n > 0, n - length + 1, 0))
    at = 0
    for e in ends:
        yield np.unique(h[at:e])
        at = e


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fp (fingerprint of the whole set, null if empty), sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("sketch", pa.list_(pa.int64()))])

    def make(batch: pa.RecordBatch, words: Words) -> list:
        sets = list(shingle_sets(words))
        return [
            batch.column(0),
            [len(s) for s in sets],
            [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
            [s[:K] for s in sets],
        ]

    return _plain(docs).mapInArrow(each_chunk(schema, make, lower=True), "doc_id long, n_shingles long, fp binary, sketch array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id and the whole sorted set of shingle hashes."""
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def make(batch: pa.RecordBatch, words: Words) -> list:
        return [batch.column(0), list(shingle_sets(words))]

    return _plain(docs).mapInArrow(each_chunk(schema, make, lower=True), "doc_id long, shingles array<long>")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def need(n: Column) -> Column:
    """Retained values that a document with a set of `n` shares with any partner."""
    return F.when(n <= SURE, F.ceil(n * PART / WHOLE)).otherwise(LEAST).cast("int")


def fit(n1: Column, n2: Column) -> Column:
    """Sets of these sizes can reach the limit."""
    return F.least(n1, n2) * WHOLE >= F.greatest(n1, n2) * PART


def rare_lists(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """(value, doc_id, n, own): the inverted lists of the rarest retained values; own counts the values that a document holds alone.

    `rows` has node and sketch, `heads` node, doc_id and n of those nodes that get into lists.
    Values of one node alone are the rarest; they count as kept but need no list.
    """
    values = rows.select("node", F.explode("sketch").alias("value"))
    shared = settle(values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"))
    held = values.join(shared, "value").groupBy("node").agg(F.sort_array(F.collect_set(F.struct("df", "value"))).alias("held"))
    kept = held.join(heads, "node").withColumn("kept", F.slice("held", 1, F.greatest(F.size("held") - need(F.col("n")) + 1, F.lit(0))))
    return kept.select("doc_id", "n", (F.least("n", F.lit(K)) - F.size("held")).alias("own"), F.explode("kept.value").alias("value"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose sketches can reach the limit and whose full sets do."""
    left, right = sets.select(
        F.col("doc_id").alias("a"),
        F.col("shingles").alias("x"),
    ), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    x, y = F.slice("x", 1, K), F.slice("y", 1, K)
    union = F.slice(F.array_sort(F.array_union(x, y)), 1, K)
    enough = F.least(need(F.size("x")), need(F.size("y")))
    likely = fit(F.size("x"), F.size("y")) & (F.size(F.array_intersect(F.array_intersect(x, y), union)) >= enough)
    common = F.size(F.array_intersect("x", "y"))
    exact = WHOLE * common >= PART * (F.size("x") + F.size("y") - common)
    return pairs.join(left, "a").join(right, "b").where(F.when(likely, exact).otherwise(False)).select("a", "b")


def common_counts(sets: list[np.ndarray], first: int, second: int) -> np.ndarray:
    """Common values of each set before `first` with each one from `second` on.

    Counted for all pairs at once, by products of 0/1 matrices over the values that occur twice,
    COLUMNS of them at a time.
    """
    values = np.concatenate(sets)
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, number, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[number] > 1
    rows, columns = rows[shared], np.unique(number[shared], return_inverse=True)[1]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    common = np.zeros((first, len(sets) - second), np.float32)
    for begin in range(0, int(columns[-1]) + 1 if len(columns) else 0, COLUMNS):
        lo, hi = np.searchsorted(columns, [begin, begin + COLUMNS])
        hits = np.zeros((len(sets), min(COLUMNS, int(columns[hi - 1]) - begin + 1)), np.float32)
        hits[rows[lo:hi], columns[lo:hi] - begin] = 1
        common += hits[:first] @ hits[second:].T
    return common


def joining(members: pd.DataFrame, first: int, second: int) -> pd.DataFrame:
    """Links (a, b) that join components, of rows before `first` with rows from `second` on.

    `members` has doc_id, comp and shingles. Pairs whose sketches can't reach the limit are left out first.
    """
    sets = members["shingles"].to_list()
    n, comp, ids = np.array([len(x) for x in sets]), members["comp"].to_list(), members["doc_id"].to_list()
    common = common_counts([x[:K] for x in sets], first, second)
    n1, n2 = n[:first, None], n[None, second:]
    least = np.where(n <= SURE, -(-n * PART // WHOLE), LEAST)
    codes = np.unique(comp, return_inverse=True)[1]
    good = (
        common >= np.maximum(least[:first, None], least[None, second:])
    ) & (np.minimum(n1, n2) * WHOLE >= PART * np.maximum(n1, n2)) & (codes[:first, None] != codes[None, second:])
    if not second:
        good = np.triu(good, 1)
    i, j = np.nonzero(good)
    order = np.argsort(-common[i, j], kind="stable")  # the likeliest first, so that few others are left to look at
    i, j = i[order], j[order] + second
    exact = None
    if len(i) > DENSE * len(sets):
        exact = common_counts(sets, first, second)[i, j - second]
        links = WHOLE * exact >= PART * (n[i] + n[j] - exact)
        i, j = i[links], j[links]
    over = {c: c for c in comp}

    def top(c: int) -> int:
        while over[c] != c:
            over[c] = c = over[over[c]]
        return c

    found = []
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        x, y = top(comp[p]), top(comp[q])
        if x == y:
            continue
        if exact is None:
            k = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
            if WHOLE * k < PART * (n[p] + n[q] - k):
                continue
        over[max(x, y)] = min(x, y)
        found.append((min(ids[p], ids[q]), max(ids[p], ids[q])))
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def within_lists(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join components within the lists in `members` (value, doc_id, n, comp).

    The largest component of a list is compared with the others, and the others among
    themselves. Both sides are cut into blocks of BLOCK members, or BLOCK_SHINGLES shingles, by a
    hash of the id; each pair of blocks is a group of its own, so no task holds more than two.
    A list of many copies and a few others so takes time in proportion to its length.
    """
    size = members.groupBy("value", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    size = size.groupBy("value").agg(F.max(F.struct("c", "s", "comp")).alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s"))

    def blocks(c: Column, s: Column) -> Column:
        return F.greatest(F.ceil(c / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")

    size = size.select(
        "value",
        F.col("top.comp").alias("top"),
        blocks(F.col("top.c"), F.col("top.s")).alias("top_blocks"),
        blocks(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("blocks"),
    )
    # settled, so that the rows of a long list can be split in this join
    m = members.join(settle(size), "value").withColumn("is_top", F.col("comp") == F.col("top"))
    m = m.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.when(F.col("is_top"), F.col("top_blocks")).otherwise(F.col("blocks"))).cast("int"))
    # groups (i, j): block -1 - i of the largest component with block j of the others, or blocks i and j of the others; a list
    # of one block on either side is one group
    others, tops = F.sequence(F.lit(0), F.col("blocks") - 1), F.sequence(F.lit(0), F.col("top_blocks") - 1)
    own = F.col("own")
    whole = (F.col("top_blocks") == 1) & (F.col("blocks") == 1)
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    of_top = F.transform(others, lambda k: F.struct((-1 - own).alias("i"), k.alias("j")))
    with_top = F.transform(tops, lambda k: F.struct((-1 - k).alias("i"), own.alias("j")))
    with_others = F.transform(others, lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    groups = F.when(whole, one).when(F.col("is_top"), of_top).otherwise(F.concat(with_top, with_others))
    m = m.withColumn("g", F.explode(groups)).select("value", "g.i", "g.j", "own", "is_top", "doc_id", "comp")
    none = pd.DataFrame({"a": [], "b": []}, dtype="int64")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["comp"].nunique() < 2:
            return none
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        if i == j:
            return joining(pdf, len(pdf), 0)
        side = pdf["is_top"] if i < 0 else pdf["own"] == i
        pdf = pd.concat([pdf[side], pdf[~side]], ignore_index=True)
        first = int(side.sum())
        return joining(pdf, first, first) if 0 < first < len(pdf) else none

    m = m.join(sets, "doc_id").select("value", "i", "j", "own", "is_top", "doc_id", "comp", "shingles")
    return m.groupBy("value", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Documents link where 100 * |intersection| >= 75 * |union| of their sets of five-word
    shingles (A-Z lower-cased; fewer words: the whole sequence as one). Null and empty texts have
    empty sets and no links. One result for each input row; rows that share a doc_id are one
    node, with the links of each of them, and rows without doc_id link with nothing. A very long
    text has a sketch like any other and is read whole. Other columns are ignored; an empty table
    gives no rows.
    """
    found = settle(sketches(docs).withColumn("node", F.xxhash64("doc_id", "fp")))
    known = found.where("fp is not null and doc_id is not null")
    # equal sets: linked to the smallest id, which stands for all
    classes = settle(known.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    of_class = settle(
        known.select("doc_id", "node", "fp", "n_shingles").join(classes, "fp", "left").select(
            "doc_id",
            "node",
            F.col("n_shingles").alias("n"),
            F.coalesce("rep", "doc_id").alias("rep"),
        ),
    )
    same = of_class.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    heads = of_class.where("doc_id = rep").select("node", "doc_id", "n").distinct()
    lists = settle(rare_lists(known, heads))
    hubs = settle(
        lists.groupBy("value").agg(F.min(F.struct("own", "doc_id", "n")).alias("hub"), F.count("*").alias("n_members")).where("n_members > 1"),
    )
    lists = settle(lists.join(hubs, "value"))
    ids = settle(lists.select("doc_id").distinct())
    sets = settle(
        full_sets(_plain(docs).join(ids, "doc_id", "left_semi")).distinct(),
    )
    stars = lists.where(
        (F.col("doc_id") != F.col("hub.doc_id")) & fit(F.col("n"), F.col("hub.n")),
    ).select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b"))
    stars = settle(stars.distinct())
    links = settle(confirmed(stars, sets))
    comp = components(links)
    # lists whose members, but for the hub that all were compared with, are not yet all in one component
    at = lists.where(F.col("doc_id") != F.col("hub.doc_id")).join(
        comp.withColumnRenamed("node", "doc_id"),
        "doc_id",
        "left",
    ).withColumn("comp", F.coalesce("component", "doc_id"))
    at = settle(at.select("value", "doc_id", "n", "comp"))
    # and only one of those that have the same members
    members_hash = F.struct(F.count("*"), F.bit_xor(F.xxhash64("doc_id")), F.bit_xor(F.xxhash64("doc_id", F.lit(1))))
    mixed = at.groupBy("value").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), members_hash.alias("same")).where("least <> most")
    mixed = settle(mixed.groupBy("same").agg(F.min("value").alias("value")).select("value"))
    more = settle(within_lists(settle(at.join(mixed, "value", "left_semi")), sets))
    comp = components(links.unionByName(more).unionByName(same))
    out = found.select("doc_id", "n_shingles").join(comp, F.col("doc_id") == F.col("node"), "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
