"""Operator 11: near-duplicates by SimHash, with a self-join of the binary trie of all fingerprints.

A fingerprint is a leaf of a binary trie, reached by its bits from the highest on. Two nodes of
the same depth are traversed together: their children make up to four pairs, each with the bits
that differ so far, and a pair over the budget of BUDGET bits is pruned with all below it. So
only pairs of nodes whose paths are close are ever looked at.

The upper part of the trie is traversed by Spark, STRIDE levels in a round: open node pairs meet
the children of both sides by equality. A pair of nodes with few fingerprints is closed and
its traversal ends in one task, over the sorted fingerprints of both; pairs with many are opened
further, so where a third of all fingerprints share a long prefix only that part gets deeper.
Each pair of nodes tells a spanning forest of its links, so dense groups don't tell all pairs.

Equal fingerprints are one leaf from the start. A node at depth d is close to at most
1 + d + d(d-1)/2 others of its depth, and d grows with the logarithm of the number of
fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import settle
from .words import Words, each_chunk

SHINGLE, SEED, BITS, BUDGET = 3, 42, 64, 2
#: Levels of the trie that one round of Spark goes down; fingerprints of two nodes whose traversal ends in one task.
STRIDE, GROUP = 4, 4096


def shingle_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, how many of each text): XXH64 of every shingle, repeats included."""
    n, length = np.diff(words.first), words.end - words.start
    # all words with one blank after each
    at = np.cumsum(length + 1) - (length + 1)
    size = int((length + 1).sum())
    line = np.full(size + 1, 32, np.uint8)
    own = np.ones(size, bool)
    own[at + length] = False
    line[:-1][own] = words.data[np.arange(size)[own] + np.repeat(words.start - at, length)]
    line = line.tobytes()
    span = np.minimum(n, SHINGLE)
    count = np.where(n > 0, n - span + 1, 0)
    first = np.arange(count.sum()) + np.repeat(words.first[:-1] - np.cumsum(count) + count, count)
    last = first + np.repeat(span, count) - 1
    digest = xxhash.xxh64_intdigest
    begin, end = at[first].tolist(), (at[last] + length[last]).tolist()
    return np.array([digest(line[a:b], SEED) for a, b in zip(begin, end, strict=True)], np.uint64), count


def fingerprint(words: Words) -> np.ndarray:
    """The fingerprint of each text: a bit is set if it is in over half of the hashes; without words it is zero."""
    h, count = shingle_hashes(words)
    out = np.zeros(words.texts, np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, (np.cumsum(count) - count)[some], axis=0, dtype=np.int32)
        packed = np.packbits(2 * sums > count[some, None], axis=1, bitorder="little")
        out[some] = np.ascontiguousarray(packed).view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(each_chunk(schema, lambda batch, words: [batch.column(0), fingerprint(words).view(np.int64)], lower=True), "doc_id long, fp long")


def close_pairs(x: np.ndarray, y: np.ndarray | None, depth: int = 0, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with x[i] and y[j] within the budget; y None: pairs i < j within x.

    x and y are sorted, distinct and unsigned, and each agrees in its first `depth` bits. A node
    is a range of them. All pairs of nodes of one depth are split at once: the ones of a bit
    stand at the end of its range.
    """
    same = y is None
    y = x if same else y
    found: list[tuple[np.ndarray, np.ndarray]] = []
    used = int(np.bitwise_count((x[:1] ^ y[:1]) >> np.uint64(BITS - depth)).sum()) if depth else 0
    node = np.array([[0], [len(x)], [0], [len(y)], [used]], np.int32)
    if same and len(x) < 2:
        node = node[:, :0]
    for bit in range(BITS - depth - 1, -2, -1):
        a, b, c, d, differ = node
        leaf = (b - a == 1) & (d - c == 1)
        i, j = a[leaf], c[leaf]
        near = np.bitwise_count(x[i] ^ y[j]) <= budget
        found.append((i[near], j[near]))
        a, b, c, d, differ = node[:, ~leaf]
        if not len(a):
            break
        ones = [np.concatenate([[0], np.cumsum((v >> np.uint64(bit)) & np.uint64(1))]).astype(np.int32) for v in ((x,) if same else (x, y))]
        m, n = b - (ones[0][b] - ones[0][a]), d - (ones[-1][d] - ones[-1][c])
        new = [(a, m, c, n, differ), (m, b, n, d, differ), (a, m, n, d, differ + 1), (m, b, c, n, differ + 1)]
        node = np.stack([np.concatenate(k) for k in zip(*new, strict=True)])
        use = (node[0] < node[1]) & (node[2] < node[3]) & (node[4] <= budget)
        if same:  # a node with itself: one of the two mixed pairs, and no leaf with itself
            use &= (node[0] < node[2]) | (node[0] == node[2]) & (node[1] - node[0] > 1)
        node = node[:, use]
    return tuple(np.concatenate(k) for k in zip(*found, strict=True))


def forest(links: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those links that join what no link before them joined."""
    over: dict[int, int] = {}

    def top(k: int) -> int:
        while over.setdefault(k, k) != k:
            over[k] = k = over[over[k]]
        return k

    out = []
    for i, j in links:
        p, q = top(i), top(j)
        if p != q:
            over[max(p, q)] = min(p, q)
            out.append((i, j))
    return out


def _prefix(fp: Column, depth: int) -> Column:
    """The first bits of a fingerprint, as a number."""
    return F.shiftrightunsigned(fp, BITS - depth)


def node_pairs(fps: DataFrame, group: int = GROUP) -> DataFrame:
    """(depth, a, b): pairs of close nodes, a = b included, that hold at most `group` fingerprints together.

    Every two fingerprints within the budget are below exactly one of the pairs.
    """
    spark = fps.sparkSession
    open_ = spark.createDataFrame([(0, 0, 0)], "a long, b long, differ int")
    closed: list[DataFrame] = []
    for depth in range(STRIDE, BITS + 1, STRIDE):
        nodes = settle(fps.groupBy(_prefix(F.col("fp"), depth).alias("node")).agg(F.count("*").alias("n")))
        above = F.shiftrightunsigned("node", STRIDE)
        left = nodes.select(above.alias("a"), F.col("node").alias("x"), F.col("n").alias("nx"))
        right = nodes.select(above.alias("b"), F.col("node").alias("y"), F.col("n").alias("ny"))
        differ = F.col("differ") + F.bit_count(F.col("x").bitwiseXOR(F.col("y")).bitwiseAND(F.lit((1 << STRIDE) - 1)))
        # children of one node: each pair once, by the order of their last bits; one leaf alone has no link
        low = lambda c: F.col(c).bitwiseAND(F.lit((1 << STRIDE) - 1))
        pairs = open_.join(left, "a").join(right, "b").where((F.col("a") != F.col("b")) | (low("x") <= low("y")))
        pairs = pairs.select(F.col("x").alias("a"), F.col("y").alias("b"), differ.cast("int").alias("differ"), "nx", "ny").where(F.col("differ") <= BUDGET)
        done = F.when(F.col("a") == F.col("b"), F.col("nx")).otherwise(F.col("nx") + F.col("ny")) <= group
        pairs = pairs.where((F.col("a") != F.col("b")) | (F.col("nx") > 1))
        pairs = settle(pairs.withColumn("done", done | F.lit(depth == BITS)))
        closed.append(pairs.where("done").select(F.lit(depth).alias("depth"), "a", "b"))
        open_ = pairs.where("not done").select("a", "b", "differ")
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, closed)


def close_links(fps: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, b): links between fingerprints within the budget that join what they join; `fps` has distinct fp."""
    pairs = settle(node_pairs(fps, group))
    asked = pairs.select("depth", F.explode(F.array("a", "b")).alias("node")).distinct()
    depths = [r["depth"] for r in pairs.select("depth").distinct().collect()]  # at most BITS / STRIDE
    if not depths:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    at = [F.struct(F.lit(d).alias("depth"), _prefix(F.col("fp"), d).alias("node")) for d in depths]
    # at most `group` fingerprints in each list
    held = fps.select("fp", F.explode(F.array(*at)).alias("at")).select("at.*", "fp")
    held = settle(held.join(asked, ["depth", "node"], "left_semi").groupBy("depth", "node").agg(F.collect_list("fp").alias("fps")))
    left = held.select("depth", F.col("node").alias("a"), F.col("fps").alias("x"))
    right = held.select("depth", F.col("node").alias("b"), F.col("fps").alias("y"))
    met = pairs.join(left, ["depth", "a"]).join(right, ["depth", "b"]).select("depth", (F.col("a") == F.col("b")).alias("same"), "x", "y")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, same = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(batch.num_rows):
                x, y = (np.sort(batch.column(c)[k].values.to_numpy().view(np.uint64)) for c in (2, 3))
                i, j = close_pairs(x, None if same[k] else y, depth[k])
                if len(i):
                    links = forest(zip(x[i].tolist(), y[j].tolist(), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in zip(*links, strict=True)], schema=schema)

    return met.mapInArrow(run, "a long, b long")


def simhash_duplicates(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    A fingerprint has a bit set where over half of the text's three-word shingles (A-Z
    lower-cased, repeats counted; fewer words: the whole sequence) have it in their XXH64 of seed
    42. Documents link where fingerprints differ in at most BUDGET bits; component_id is the
    smallest doc_id reachable. Null and empty texts have fingerprint zero and link like others.
    One result for each input row: rows that share a doc_id link as each of their texts does,
    rows of null doc_id have a null component and link nothing. A very long text is read whole
    and has a fingerprint like any other. Other columns are ignored; an empty table gives no rows.
    """
    found = settle(fingerprints(docs))
    leaves = settle(found.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    links = close_links(leaves.select("fp"), group)
    # rows that share a doc_id join their fingerprints
    shared = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("m"), F.count("*").alias("n")).where("a <> m")
    shared = found.join(shared.select("doc_id", "a"), "doc_id").select("a", F.col("fp").alias("b")).where("a <> b")
    comp = components(links.unionByName(shared))
    member = leaves.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    member = settle(member)
    least = member.groupBy("component").agg(F.min("rep").alias("component_id"))
    member = settle(member.join(least, "component").select(F.col("fp").alias("leaf"), "component_id"))
    out = found.join(member, found["fp"] == member["leaf"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"))
