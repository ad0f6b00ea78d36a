"""Operator 6: repeated word sequences found from difference-cover anchors.

COVER is a perfect difference set modulo PERIOD: for any two positions there is a shift below
PERIOD that brings both onto cover positions. So if the same WINDOW words start at two places,
the same SEED = WINDOW - PERIOD + 1 words start at a cover position of both. Only those seeds
are hashed and grouped. A match extends from a repeated seed by at most PERIOD - 1 words to
either side, so only the windows around repeated seeds are hashed and grouped in turn; that
second grouping decides.

Both groupings shuffle one small row for each text and hash. What a task sees repeated among
its own texts is known to repeat and needs no group; of each such hash it sends one row for all
of them. So a hash that many texts hold makes a group of at most one row for each run of texts.
Texts are shuffled once and meet both results there. Rows of equal text are told by a count.

Hashes have 64 bits. Two different windows in a hundred thousand million million (10**14)
windows have equal ones by chance in some hundred million cases, or 1 in 300,000 windows, and
only where both hold a repeated seed does this matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .words import Words, chunks, each_chunk, mix

WINDOW = 35
#: A perfect difference set. Fixed values.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
SEED = WINDOW - PERIOD + 1
_IS_COVER = np.isin(np.arange(PERIOD), COVER)
#: Hashes that a task gathers before it sends them.
RUN = 1 << 19
#: Bits of a text's reference. Of two texts that share one, a window that both hold counts as one text's: so all 64 are used.
REF_BITS = 64


def _texts(docs: DataFrame) -> DataFrame:
    """ref, same and same2 (hashes of the text), doc_id, text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    same = F.xxhash64("text")
    return plain.select(
        F.shiftrightunsigned(same, 64 - REF_BITS).alias("ref"),
        same.alias("same"),
        F.xxhash64(F.lit("again"), "text").alias("same2"),
        "doc_id",
        "text",
    )


def _places(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text number and position in the text of every word."""
    of = np.repeat(np.arange(words.texts), np.diff(words.first))
    return of, np.arange(len(of)) - words.first[of]


def seeds(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word, hash) of the seeds at cover positions of texts that have a window."""
    n = np.diff(words.first)
    of, at = _places(words)
    use = np.flatnonzero((n[of] >= WINDOW) & (at + SEED <= n[of]) & _IS_COVER[at % PERIOD])
    return of[use], use, words.windows(use, SEED) if len(use) else np.zeros(0, np.uint64)


def _listed(of: np.ndarray, h: np.ndarray, lists: pa.Array) -> np.ndarray:
    """For pairs (text number, hash): is the hash in the text's list? A null list is empty."""
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    tag = lambda k, x: x ^ mix(k.astype(np.uint64))
    return np.isin(tag(of, h), tag(np.repeat(np.arange(len(lists)), n), values))


def near_windows(words: Words, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the windows that hold one of the text's listed seeds."""
    n = np.diff(words.first)
    of, at, h = seeds(words)
    hot = _listed(of, h, lists)
    near = np.zeros(len(words.start) + 1, np.int32)
    np.add.at(near, np.maximum(words.first[of[hot]], at[hot] - (PERIOD - 1)), 1)
    np.add.at(near, at[hot] + 1, -1)
    text, place = _places(words)
    use = np.flatnonzero((np.cumsum(near)[:-1] > 0) & (place + WINDOW <= n[text]))
    return text[use], words.windows(use, WINDOW) if len(use) else np.zeros(0, np.uint64)


def _combined(ref: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """Columns to, ref, h of a run's rows: h is set in rows that need no group, and `to` is then any number."""
    order = np.argsort(h, kind="stable")
    ref, h = ref[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    group = np.cumsum(new) - 1
    known = np.bincount(group, minlength=1)[group] > 1 if len(h) else np.zeros(0, bool)
    # one row of each hash for the groups; each text once for what is known
    pairs = np.unique(np.stack([h[known], ref[known].view(np.uint64)]), axis=1) if known.any() else np.zeros((2, 0), np.uint64)
    to = np.concatenate([h[new], mix(pairs[0] ^ mix(pairs[1]))]).view(np.int64)
    found = np.concatenate([h[new], pairs[0]]).view(np.int64)
    none = np.arange(len(found)) < int(new.sum())
    return [pa.array(to), pa.array(np.concatenate([ref[new], pairs[1].view(np.int64)])), pa.array(found, mask=none)]


def hash_rows(texts: DataFrame, make: Callable[[Words, pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(to, ref, h) for the (text number, hash) that `make` finds; a text that a run of rows repeats is read once."""
    schema = pa.schema([("to", pa.int64()), ("ref", pa.int64()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, done = 0, np.zeros(0, np.uint64)
        for batch in batches:
            refs, same, same2 = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("ref", "same", "same2"))
            texts_of = mix(same.view(np.uint64)) ^ same2.view(np.uint64)  # texts are told by two hashes, not by references
            for at, end, data, offsets in chunks(batch.column(batch.schema.get_field_index("text"))):
                own, whole = refs[at:end], texts_of[at:end]
                of, h = make(Words(data, offsets), batch.slice(at, end - at))
                fresh = np.zeros(len(own), bool)
                fresh[np.unique(whole, return_index=True)[1]] = True
                use = (fresh & ~np.isin(whole, done))[of]
                held.append((own[of[use]], h[use]))
                done = np.concatenate([done, whole[fresh]])
                size += int(use.sum())
                if size >= RUN or len(done) >= RUN:
                    yield pa.RecordBatch.from_arrays(_combined(*(np.concatenate(x) for x in zip(*held, strict=True))), schema=schema)
                    held, size, done = [], 0, np.zeros(0, np.uint64)
        if size:
            yield pa.RecordBatch.from_arrays(_combined(*(np.concatenate(x) for x in zip(*held, strict=True))), schema=schema)

    return texts.mapInArrow(run, "to long, ref long, h long")


def repeated(rows: DataFrame) -> DataFrame:
    """(ref, h): the hashes that another text holds too, or the same text twice."""
    group = W.partitionBy("to")
    rows = rows.withColumn("least", F.min("ref").over(group)).withColumn("most", F.max("ref").over(group))
    return rows.where("h is not null or least <> most").select("ref", F.coalesce("h", "to").alias("h"))


def _keep(schema: pa.Schema, texts: bool):
    """Columns doc_id, n_words, n_removed and the digest of the kept words, or the kept words themselves."""

    def columns(batch: pa.RecordBatch, words: Words) -> list:
        n = np.diff(words.first)
        spots, copied = (batch.column(batch.schema.get_field_index(c)) for c in ("spots", "copied"))
        copied = copied.to_numpy(zero_copy_only=False).astype(bool) & (n >= WINDOW)
        some = spots.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) > 0
        of, at = _places(words)
        use = np.flatnonzero(some[of] & ~copied[of] & (at + WINDOW <= n[of]))
        gone = np.zeros(len(of) + 1, np.int32)
        if len(use):
            dup = use[_listed(of[use], words.windows(use, WINDOW), spots)]
            np.add.at(gone, dup, 1)
            np.add.at(gone, dup + WINDOW, -1)
        gone = (np.cumsum(gone)[:-1] > 0) | copied[of]
        data = words.data.tobytes()
        removed, kept = [], []
        for k in range(words.texts):
            a, b = words.first[k], words.first[k + 1]
            if a == b or not gone[a:b].any():
                lo, hi = (words.start[a], words.end[b - 1]) if a < b else (0, 0)
                left = b" ".join(data[lo:hi].split())
            else:
                left = b" ".join([data[words.start[i] : words.end[i]] for i in np.flatnonzero(~gone[a:b]) + a])
            removed.append(int(gone[a:b].sum()))
            kept.append(left.decode() if texts else hashlib.sha256(left).hexdigest())
        return [batch.column(batch.schema.get_field_index("doc_id")), n, removed, kept]

    return each_chunk(schema, columns)


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (or kept_text) of every row.

    A word goes if a window of 35 words covers it whose sequence also starts anywhere else, in
    the same document or another. One result for each input row; a repeated row repeats all its
    windows and loses every word of a text of 35 words or more. Null and empty texts have no
    words and the digest of the empty string; shorter texts stay whole; very long ones are read
    whole. Rows of null id are handled like others; an empty table gives no rows.
    """
    plain = _texts(docs)
    last = "kept_text" if texts else "kept_sha256"
    hot = repeated(hash_rows(plain.select("ref", "same", "same2", "text"), lambda words, _: seeds(words)[::2]))
    near = plain.join(hot.groupBy("ref").agg(F.collect_list("h").alias("hot")), "ref").select("ref", "same", "same2", "doc_id", "text", "hot")
    spots = repeated(hash_rows(near, lambda words, batch: near_windows(words, batch.column(5))))
    copies = plain.groupBy("ref", "same", "same2").agg(F.count("*").alias("n")).where("n > 1")
    told = spots.select("ref", "h", F.lit(None).cast("struct<same:bigint,same2:bigint>").alias("copy")).unionByName(
        copies.select("ref", F.lit(None).cast("long").alias("h"), F.struct("same", "same2").alias("copy")),
    )
    told = told.groupBy("ref").agg(F.collect_list("h").alias("spots"), F.collect_set("copy").alias("copies"))
    final = plain.join(told, "ref", "left").select(
        "ref",
        "same",
        "same2",
        "doc_id",
        "text",
        "spots",
        F.coalesce(F.array_contains("copies", F.struct("same", "same2")), F.lit(False)).alias("copied"),
    )
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), (last, pa.string())])
    return final.mapInArrow(_keep(schema, texts), f"doc_id long, n_words long, n_removed long, {last} string")
