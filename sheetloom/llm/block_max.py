"""Operator 13: ranked lexical search with Block-Max WAND over compressed posting blocks.

`build_index` turns documents into segments, each made by one task of some thousand of its rows. In
a segment documents are numbered by doc_id, and every term has a list of postings in blocks
of BLOCK: gaps and counts in as few bytes as the block needs, with the block's last document,
its largest impact and its place beside it. The impact is the part of a score that is known
without the query, so a term's weight times the largest impact bounds what a block can add.

`search` sends the lists of the queries' terms to their segments. There each query moves a
shallow pointer in every list from the end of a block to the next one, over the blocks' ends
alone: between two ends the sum of the current blocks' bounds holds for all documents, and where it
is below the score of the K-th best so far, the blocks are passed over and not decompressed.
A first round over one segment in SAMPLE gives each query a threshold that the others start from,
so most segments send few rows or none. Documents that tie with the threshold are kept.

Terms are known by hashes of 64 bits; with a thousand million terms in the index, one of a
hundred thousand query terms shares its hash with another one in 1 of 200,000 indexes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import settle
from .words import NO_TERM, Words, chunks, each_chunk

#: Results of each query, and postings of a block.
K, BLOCK = 10, 128
#: Postings and documents of a segment, about; one longer text makes a larger segment.
POSTINGS, DOCUMENTS = 1 << 20, 1 << 14
#: One segment in so many gives the first thresholds.
SAMPLE = 16
#: Query terms that are sent to all tasks at once, about; more are searched in further rounds of so many.
QUERY_TERMS = 1 << 20
#: Stretches between block ends that are looked at first, the most promising ones; later steps take twice as many each.
STEP = 32

INDEX = "segment long, term long, df int, ids array<long>, norms array<long>, last array<int>, top array<int>, at array<int>, postings binary"
_SCHEMA = pa.schema(
    [("segment", pa.int64()), ("term", pa.int64()), ("df", pa.int32()), ("ids", pa.list_(pa.int64())), ("norms", pa.list_(pa.int64()))]
    + [(c, pa.list_(pa.int32())) for c in ("last", "top", "at")]
    + [("postings", pa.binary())]
)


def _plain(table: DataFrame, key: str) -> DataFrame:
    return table.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))


def collection(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms of all documents with repeats)."""
    schema = pa.schema([("docs", pa.int64()), ("terms", pa.int64())])

    def count(batch: pa.RecordBatch, words: Words) -> list:
        return [[int((np.diff(words.first) > 0).sum())], [len(words.start)]]

    counts = _plain(docs, "doc_id").mapInArrow(each_chunk(schema, count, lower=True, breaks=NO_TERM), "docs long, terms long")
    row = counts.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    return row[0], row[1]


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(first, len(values)), pa.int32()), pa.array(values))


def packed(gaps: np.ndarray, tf: np.ndarray, block: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each block begins in them): a byte for both widths, then the gaps, then the counts.

    `block` is the number of each posting's block, `begin` each block's first posting.
    """
    size = np.diff(np.append(begin, len(gaps)))
    place = np.arange(len(gaps)) - begin[block]
    widths = []
    for values in (gaps, tf):
        most = np.maximum.reduceat(values, begin)
        widths.append(np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4)))
    total = 1 + size * (widths[0] + widths[1])
    at = np.cumsum(total) - total
    out = np.zeros(int(total.sum()), np.uint8)
    out[at] = widths[0] + 16 * widths[1]
    for values, width, start in ((gaps, widths[0], at + 1), (tf, widths[1], at + 1 + size * widths[0])):
        for w in (1, 2, 4):
            use = np.flatnonzero(width[block] == w)
            to = start[block[use]] + place[use] * w
            for k in range(w):
                out[to + k] = values[use] >> (8 * k) & 255
    return out, at


def unpacked(data: bytes, at: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(gaps, counts) of a block of `size` postings."""
    gap, tf = data[at] & 15, data[at] >> 4
    read = lambda w, a: np.frombuffer(data, f"<u{w}", size, a)
    return read(gap, at + 1), read(tf, at + 1 + size * gap)


def _segment(number: int, ids: list, size: np.ndarray, of: np.ndarray, term: np.ndarray, tf: np.ndarray, stats: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The rows of one segment: its documents (term is null), then a row for each term."""
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
    ids = [ids[k] for k in order]
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    norms = 10 + (90 * size[order] * stats[0]) // stats[1]
    yield pa.RecordBatch.from_pylist([{"segment": number, "ids": ids, "norms": norms.tolist()}], schema=_SCHEMA)
    doc = rank[of]
    by = np.lexsort((doc, term))
    doc, term, tf = doc[by], term[by], tf[by]
    new = np.flatnonzero(np.append(True, term[1:] != term[:-1]))  # first posting of each list
    df = np.diff(np.append(new, len(term)))
    place = np.arange(len(term)) - np.repeat(new, df)
    begin = np.flatnonzero(place % BLOCK == 0)
    block = np.cumsum(place % BLOCK == 0) - 1
    gaps = np.where(place == 0, doc, doc - np.append(0, doc[:-1]))
    data, at = packed(gaps, tf, block, begin)
    first = block[new]  # first block of each list
    held = np.diff(np.append(first, len(begin)))
    own = at[first]
    top = np.maximum.reduceat(impacts(tf, norms[doc]), begin)
    last = doc[np.append(begin[1:], len(doc)) - 1]
    n = len(new)
    postings = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(own, len(data)).astype(np.int32)), pa.py_buffer(data)])
    columns = [np.full(n, number), term[new].view(np.int64), df.astype(np.int32), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]
    columns += [_lists(x.astype(np.int32), first) for x in (last, top, at - np.repeat(own, held))]
    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in [*columns, postings]], schema=_SCHEMA)


def build_index(docs: DataFrame, stats: tuple[int, int]) -> DataFrame:
    """The index of all documents with a term, in rows of INDEX; nothing is shuffled. `stats` are those of `collection`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, held = [], []
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                words = Words(data, offsets, True, NO_TERM)
                n = np.diff(words.first)
                some = np.flatnonzero(n)
                of = np.repeat(np.arange(len(some)), n[some])
                h = words.hashes() if len(of) else np.zeros(0, np.uint64)
                by = np.lexsort((h, of))
                of, h = of[by], h[by]
                new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (h[1:] != h[:-1]))) if len(of) else np.zeros(0, np.int64)
                held.append((n[some], of[new] + len(ids), h[new], np.diff(np.append(new, len(of)))))
                ids += batch.column(0).slice(a, b - a).take(pa.array(some)).to_pylist()
                if len(ids) >= DOCUMENTS or sum(len(x[1]) for x in held) >= POSTINGS:
                    yield from _segment(number, ids, *(np.concatenate(x) for x in zip(*held, strict=True)), stats)
                    number, ids, held = number + 1, [], []
        if ids:
            yield from _segment(number, ids, *(np.concatenate(x) for x in zip(*held, strict=True)), stats)

    return _plain(docs, "doc_id").mapInArrow(run, INDEX)


class List:
    """A term's postings in a segment; blocks are decompressed when they are first asked for."""

    def __init__(self, df: int, last: np.ndarray, top: np.ndarray, at: np.ndarray, postings: bytes, norms: np.ndarray):
        self.df, self.last, self.top, self.at, self.data, self.norms = df, last, top, at, postings, norms
        self.doc, self.impact = np.empty(df, np.int64), np.empty(df, np.int64)
        self.open = np.zeros(len(last), bool)

    def postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of these blocks."""
        for k in blocks[~self.open[blocks]].tolist():
            a, b = k * BLOCK, min(self.df, (k + 1) * BLOCK)
            gaps, tf = unpacked(self.data, int(self.at[k]), b - a)
            np.cumsum(gaps, out=self.doc[a:b])
            self.doc[a:b] += self.last[k - 1] if k else 0
            self.impact[a:b] = impacts(tf, self.norms[self.doc[a:b]])
            self.open[k] = True
        if len(blocks) == len(self.open):
            return self.doc, self.impact
        use = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        use = use[use < self.df]
        return self.doc[use], self.impact[use]


def best(lists: list[tuple[List, int]], n: int, threshold: int = 0, k: int = K) -> list[tuple[int, int]]:
    """(document, score) of the k best of a segment's n documents, highest score, then smallest number first.

    `lists` has a term's list and weight. Documents with scores below `threshold` may be left out.
    """
    ends = np.unique(np.concatenate([x.last for x, _ in lists]))
    bound, current = np.zeros(len(ends), np.int64), []
    for x, weight in lists:  # shallow pointers: the block of each list that is current up to each end
        at = np.searchsorted(x.last, ends)
        there = at < len(x.last)
        bound[there] += weight * x.top[at[there]].astype(np.int64)
        current.append(np.where(there, at, -1))
    stretch = np.searchsorted(ends, np.arange(n))
    top_doc, top_score = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting = np.ones(len(ends), bool)
    score, step = np.zeros(n, np.int64), STEP
    while True:
        left = np.flatnonzero(waiting & (bound >= max(threshold, 1)))
        if not len(left):
            break
        # the most promising stretches come first, so that the threshold is high for those that follow in order
        some = np.argpartition(-bound[left], step)[:step] if step == STEP < len(left) else slice(0, step)
        chosen = np.zeros(len(ends) + 1, bool)
        chosen[left[some]] = True
        waiting &= ~chosen[:-1]
        step *= 2
        touched = []
        for (x, weight), at in zip(lists, current, strict=True):
            blocks = np.unique(at[chosen[:-1]])
            doc, impact = x.postings(blocks[blocks >= 0])
            use = chosen[stretch[doc]]
            doc = doc[use]
            score[doc] += weight * impact[use]
            touched.append(doc)
        doc = np.unique(np.concatenate(touched))
        doc = doc[score[doc] >= max(threshold, 1)]
        top_doc, top_score = np.append(top_doc, doc), np.append(top_score, score[doc])
        order = np.lexsort((top_doc, -top_score))[:k]
        top_doc, top_score = top_doc[order], top_score[order]
        if len(order) == k:
            threshold = max(threshold, int(top_score[-1]))
    return list(zip(top_doc.tolist(), top_score.tolist(), strict=True))


_FOUND = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _in_segments(index: DataFrame, queries) -> DataFrame:
    """(item_id, doc_id, score): the best of each segment for each query. `queries` is broadcast: (item_id, threshold, terms, weights)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        term = table["term"].fill_null(0).to_numpy()
        head = int(np.flatnonzero(table["term"].is_null().to_numpy())[0])
        ids, norms = table["ids"][head].values, table["norms"][head].values.to_numpy()
        df = table["df"].to_numpy()
        parts = [table[c].chunk(0) for c in ("last", "top", "at")]
        lists = {}
        for k in range(table.num_rows):
            if k != head:
                columns = [p[k].values.to_numpy() for p in parts]
                lists[int(term[k])] = List(int(df[k]), *columns, table["postings"][k].as_py(), norms)
        out = []
        for item, threshold, terms, weights in queries.value:
            held = [(lists[t], w) for t, w in zip(terms, weights, strict=True) if t in lists]
            if held:
                out += [(item, d, s) for d, s in best(held, len(norms), threshold)]
        item, doc, score = zip(*out, strict=True) if out else ((), (), ())
        doc = ids.take(pa.array(doc, pa.int64()))
        return pa.Table.from_arrays([pa.array(item, pa.int64()), doc, pa.array(score, pa.int64())], schema=_FOUND)

    return index.groupBy("segment").applyInArrow(run, "item_id long, doc_id long, score long")


def _ranked(found: DataFrame) -> DataFrame:
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= K)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the terms of each item, once each."""
    schema = pa.schema([("item_id", pa.int64()), ("terms", pa.list_(pa.int64()))])

    def make(batch: pa.RecordBatch, words: Words) -> list:
        h = words.hashes().view(np.int64) if len(words.start) else np.zeros(0, np.int64)
        return [batch.column(0), [np.unique(h[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]]

    plain = _plain(items, "item_id").where("item_id is not null")
    found = plain.mapInArrow(each_chunk(schema, make, lower=True, breaks=NO_TERM), "item_id long, terms array<long>")
    return found.select("item_id", F.explode("terms").alias("term")).distinct()


def search(index: DataFrame, items: DataFrame, stats: tuple[int, int], sample: int = SAMPLE, query_terms: int = QUERY_TERMS) -> DataFrame:
    """item_id, doc_id, score, rank: the K best documents of the index for each item.

    A term weighs floor(1000 * ln((2N + 2) / (2df + 1))); those of no weight are left out.
    """
    terms = settle(item_terms(items))
    lists = index.where("term is not null")
    df = lists.select("term", "df").join(terms.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * stats[0] + 2) / (2 * F.col("df") + 1)))
    weighed = settle(terms.join(df.select("term", weight.cast("long").alias("w")).where("w > 0"), "term"))
    blocks = -(-weighed.count() // query_terms)
    in_block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    in_sample = F.pmod(F.xxhash64("segment"), F.lit(sample)) == 0
    sc, out = index.sparkSession.sparkContext, None
    for k in range(blocks):
        part = weighed.where(in_block == k)
        rows = part.groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("terms")).collect()  # bounded by the block
        queries = [(r["item_id"], 0, [t["term"] for t in r["terms"]], [t["w"] for t in r["terms"]]) for r in rows]
        asked = lists.join(part.select("term").distinct(), "term", "left_semi").unionByName(index.where("term is null")).select(*index.columns)
        found = settle(_ranked(_in_segments(asked.where(in_sample), sc.broadcast(queries))))
        least = {r["item_id"]: r["score"] for r in found.where(F.col("rank") == K).select("item_id", "score").collect()}  # one for each item of the block
        queries = [(q[0], least.get(q[0], 0), *q[2:]) for q in queries]
        rest = _in_segments(asked.where(~in_sample), sc.broadcast(queries))
        found = _ranked(found.drop("rank").unionByName(rest))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return index.sparkSession.createDataFrame([], "item_id long, doc_id long, score long, rank int")
    return out


def rank_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: each item's K documents of highest score above 0, equal scores by doc_id.

    Terms are runs of digits, letters and all that isn't ASCII, A-Z lower-cased. Null and empty texts have none: such
    documents count nowhere, such items have no rows. Every row of `docs` is a document of its
    own, repeated rows too; one of null doc_id comes after those that it ties with. Rows of one
    item_id are one item with the terms of all of them; null item_ids are left out. Very long
    texts are read whole. Other columns are ignored; where either table is empty there are no rows.
    """
    stats = collection(docs)
    index = settle(build_index(docs, stats))
    return search(index, items, stats).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
