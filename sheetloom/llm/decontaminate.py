"""Operator 9: training passages that copy test items, by n-gram seeds and local alignment.

Every document is searched for the word n-grams of the test items. A first pass counts the
documents that hold each n-gram; the rare ones are seeds, and one that survives the editing of a
copy is enough to find it. An n-gram isn't rare if it is in more than RARE_SHARE of all documents
(and in more than RARE); an item that would be left with seeds for less than half of its
n-grams, as one that leaked everywhere, keeps all of them. So a copy is lost only if all n-grams
it keeps are common ones; with `rare=None` all n-grams are seeds and none is. A second pass joins seeds: items that
have too few words in common with the document to reach the limit are passed over; around the
seeds of the others, Smith-Waterman alignment of words scores the passage against the item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import settle
from .words import Words, each_chunk

GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of the score that a perfect copy of the item would get.
LIMIT = 0.5
#: An n-gram in so many documents is rare in any case, and so is one in this share of them.
RARE, RARE_SHARE = 1000, 0.001
#: Words of items that are sent to all tasks at once, about; more are done in further rounds of so many.
ITEM_WORDS = 1 << 20


def items_table(benchmark: DataFrame) -> DataFrame:
    """item_id, words (hashes of the A-Z lower-cased words) and grams of every item that has a word."""
    schema = pa.schema([("item_id", pa.int64()), ("words", pa.list_(pa.int64())), ("grams", pa.list_(pa.int64()))])

    def make(batch: pa.RecordBatch, words: Words) -> list:
        h, first = words.hashes().view(np.int64), words.first
        grams = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            r = min(GRAM, b - a)
            at = np.arange(a, b - r + 1 if r else a)
            grams.append(words.windows(at, r).view(np.int64) if len(at) else np.zeros(0, np.int64))
        return [batch.column(0), [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)], grams]

    plain = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    return plain.mapInArrow(
        each_chunk(schema, make, lower=True),
        "item_id long, words array<long>, grams array<long>",
    ).where("size(words) > 0").dropDuplicates(["item_id", "words"])


class Index:
    """The n-grams of a block of items: `grams` in order, and the items that hold each of them.

    Item k has the words `words[first[k] : first[k + 1]]`; its n-grams, as numbers in `grams`, are
    `held[held_first[k] : held_first[k + 1]]`. `holders[at[g] : at[g + 1]]` are the items with n-gram g.
    """

    def __init__(self, ids: list, words: list, grams: list):
        self.ids = np.array(ids, np.int64)
        self.first = np.cumsum([0, *map(len, words)])
        self.held_first = np.cumsum([0, *map(len, grams)])
        self.words = np.concatenate(words).astype(np.int64)
        self.known, self.number = np.unique(self.words, return_inverse=True)
        self.grams, self.held = np.unique(np.concatenate(grams).astype(np.int64), return_inverse=True)
        pairs = np.unique(np.stack([self.held, np.repeat(np.arange(len(grams)), np.diff(self.held_first))]), axis=1)
        self.holders, self.at = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.grams) + 1))
        self.lengths = range(min([GRAM, *map(len, words)]), GRAM + 1)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.grams & (len(self.maybe) - 1)] = True

    def seeded(self, documents: np.ndarray, rare: float) -> None:
        """Leave those n-grams out of `holders` that are in more than `rare` documents, but for items that need them."""
        item = np.repeat(np.arange(len(self.ids)), np.diff(self.held_first))
        low = documents[self.held] <= rare
        few = 2 * np.bincount(item, low, len(self.ids)) < np.diff(self.held_first)
        gram = np.repeat(np.arange(len(self.grams)), np.diff(self.at))
        use = (documents[gram] <= rare) | few[self.holders]
        self.holders, self.at = self.holders[use], np.searchsorted(gram[use], np.arange(len(self.grams) + 1))


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges from `begin` up to `end`, one range after the other."""
    n = end - begin
    return np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)


def gram_hits(words: Words, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(number in index.grams, word) of each place where the texts hold one of the n-grams, in order of words."""
    last = np.repeat(words.first[1:], np.diff(words.first))
    found = []
    for r in index.lengths:
        use = np.flatnonzero(np.arange(len(last)) + r <= last)
        g = words.windows(use, r).view(np.int64) if len(use) else np.zeros(0, np.int64)
        hit = index.maybe[g & (len(index.maybe) - 1)]
        use, g = use[hit], g[hit]
        k = np.minimum(np.searchsorted(index.grams, g), len(index.grams) - 1)
        hit = index.grams[k] == g
        found.append((k[hit], use[hit]))
    k, use = (np.concatenate([f[j] for f in found]) for j in (0, 1))
    order = np.argsort(use, kind="stable")
    return k[order], use[order]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(score, begin, end): the best local alignment's score and its range of `passage`."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        steps = -GAP * np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64)
        score, end = 0, 0
        for w in a:
            new = np.zeros_like(row)
            np.maximum(row[:-1] + np.where(b == w, MATCH, MISMATCH), row[1:] + GAP, out=new[1:])
            np.maximum(new, 0, out=new)
            row = np.maximum.accumulate(new + steps) - steps  # gaps along the passage
            k = int(row.argmax())
            if row[k] > score:
                score, end = int(row[k]), k
        return score, end

    score, end = best(item, passage)
    _, back = best(item[::-1], passage[:end][::-1])
    return score, end - back, end


def passages(text: np.ndarray, hits: np.ndarray, at: np.ndarray, index: Index, limit: float) -> list[tuple]:
    """(item_id, score, begin, end) of the items that `text` (hashes of words) holds a copy of.

    `hits` are the n-grams found in it, in order, and `at` their places. A score can't be above the share of an
    item's words that occur in the text, so items below the limit by that are not aligned.
    """
    seen = np.unique(hits)
    items = np.unique(index.holders[_ranges(index.at[seen], index.at[seen + 1])])
    if not len(items):
        return []
    present = np.isin(index.known, text)
    begin, size = index.first[items], index.first[items + 1] - index.first[items]
    common = np.add.reduceat(present[index.number[_ranges(begin, begin + size)]], np.cumsum(size) - size, dtype=np.int64)
    out = []
    for k in items[common / size >= limit]:
        item, held = index.words[index.first[k] : index.first[k + 1]], index.held[index.held_first[k] : index.held_first[k + 1]]
        low, high = np.searchsorted(hits, held), np.searchsorted(hits, held, side="right")
        diagonals = np.unique(at[_ranges(low, high)] - np.repeat(np.arange(len(held)), high - low))
        pad = len(item) // 2 + 1
        cuts = np.flatnonzero(np.diff(diagonals) > len(item) + 2 * pad) + 1  # passages that overlap are aligned as one
        found = (0, 0, 0)
        for d in np.split(diagonals, cuts):
            a = max(0, int(d[0]) - pad)
            passage = text[a : int(d[-1]) + len(item) + pad]
            if np.isin(item, passage).sum() / len(item) >= limit:
                s, b, e = align(item, passage)
                found = max(found, (s, a + b, a + e), key=lambda x: x[0])
        score = found[0] / (MATCH * len(item))
        if score >= limit:
            out.append((int(index.ids[k]), score, *found[1:]))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, limit: float = LIMIT, rare: int | None = RARE, item_words: int = ITEM_WORDS) -> DataFrame:
    """doc_id, item_id, score, begin, end: each document and item it holds a copy of.

    score is the alignment's share of a perfect copy's score, at least `limit`; begin and end
    are words of the document. Words compare with A-Z lower-cased. Rows of null doc_id or
    item_id are left out, null and empty texts hold nothing; items of fewer than three words use
    their whole sequence as a seed. A copy that keeps no three words in a row has no seed and is
    not found, nor one that keeps only n-grams that aren't seeds by `rare` (None: all are). A row that is
    repeated gives its pairs once. Very long texts are read whole. Other columns are ignored; either table
    empty: no rows.
    """
    plain = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = settle(items_table(benchmark))
    blocks = -(-items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0] // item_words)
    most = None if rare is None else max(rare, RARE_SHARE * plain.count()) if blocks else 0
    out = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "words").collect()  # bounded by the block
        if part:
            part = _block(plain, part, limit, most)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, begin int, end int")
    return out.dropDuplicates(["doc_id", "item_id", "begin", "end"])


def gram_counts(plain: DataFrame, table) -> DataFrame:
    """(gram, n): the documents that hold each n-gram of the index, by its number; `table` is the broadcast index."""
    schema = pa.schema([("gram", pa.int32()), ("n", pa.int64())])

    def make(batch: pa.RecordBatch, words: Words) -> list:
        hits, use = gram_hits(words, table.value)
        text = np.repeat(np.arange(words.texts), np.diff(words.first))[use]
        once = np.unique(text * len(table.value.grams) + hits)
        return list(np.unique(once % len(table.value.grams), return_counts=True))

    found = plain.mapInArrow(each_chunk(schema, make, lower=True), "gram int, n long")
    return found.groupBy("gram").agg(F.sum("n").alias("n"))


def _block(plain: DataFrame, rows: list, limit: float, most: float | None) -> DataFrame:
    """The copies of the items in `rows`; n-grams in more than `most` documents aren't seeds, if it is given."""
    sc = plain.sparkSession.sparkContext
    index = Index([r["item_id"] for r in rows], [r["words"] for r in rows], [r["grams"] for r in rows])
    if most is not None:
        counts = gram_counts(plain, sc.broadcast(index)).toPandas()  # at most the n-grams of the block
        documents = np.zeros(len(index.grams), np.int64)
        documents[counts["gram"]] = counts["n"]
        index.seeded(documents, most)
    table = sc.broadcast(index)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("begin", pa.int32()), ("end", pa.int32())])

    def make(batch: pa.RecordBatch, words: Words) -> list:
        hits, use = gram_hits(words, table.value)
        cuts = np.searchsorted(use, words.first)
        h, out = words.hashes().view(np.int64), []
        for k in np.flatnonzero(np.diff(cuts)):
            found, begin = slice(cuts[k], cuts[k + 1]), words.first[k]
            order = np.argsort(hits[found], kind="stable")
            doc = batch.column(0)[int(k)].as_py()
            out += [(doc, *p) for p in passages(h[begin : words.first[k + 1]], hits[found][order], use[found][order] - begin, table.value, limit)]
        return [list(x) for x in zip(*out, strict=True)] if out else [[]] * 5

    return plain.mapInArrow(each_chunk(schema, make, lower=True), "doc_id long, item_id long, score double, begin int, end int")
