"""Words of a text column, found and hashed for a whole Arrow batch at once.

A word is a run of code points other than space and U+0009 to U+000D. These are single bytes
in UTF-8 and part of no other code point, so everything here works on bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text handled at once, so that the arrays made of them stay small; one longer text is still handled whole.
CHUNK_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Breaks between terms: ASCII but for digits and letters.
NO_TERM = np.arange(256) < 128
NO_TERM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1000, 1256, dtype=np.uint64))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64.

    As many as a usual chunk needs are kept; for a longer text they are made for this once, so
    that a worker doesn't hold on to them.
    """

    KEPT = 2 * CHUNK_BYTES

    def __init__(self, base: int):
        self.bases = base, pow(base, -1, 1 << 64)
        self.kept = None

    def _make(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for b in self.bases:
            x = np.full(n, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        return out[0], out[1]

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.KEPT:
            return self._make(n)
        if self.kept is None:
            self.kept = self._make(self.KEPT)
        return self.kept[0][:n], self.kept[1][:n]


_OF_BYTES, _OF_WORDS = _Powers(0x9FB21C651E98DF25), _Powers(0xD6E8FEB86659FD93)


class Words:
    """The words of consecutive texts: byte range, hash and text number of each.

    `first[d]` to `first[d + 1]` are the words of text d. `breaks` tells the bytes between words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, breaks: np.ndarray = _SPACE):
        data = _LOWER[data] if lower else data
        n = len(data)
        self.data, self.texts = data, len(offsets) - 1
        if n:
            space = breaks[data]
            before, after = np.empty(n, bool), np.empty(n, bool)
            before[0] = after[-1] = True
            before[1:], after[:-1] = space[:-1], space[1:]
            before[offsets[:-1][offsets[:-1] < n]] = True
            after[offsets[1:][offsets[1:] > 0] - 1] = True
            self.start = np.flatnonzero(~space & before)
            self.end = np.flatnonzero(~space & after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offsets)
        self._sums = None

    def hashes(self) -> np.ndarray:
        up, down = _OF_BYTES.get(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[:-1], out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * down[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64))

    def windows(self, start: np.ndarray, length) -> np.ndarray:
        """Hashes of the sequences of `length` words (a number or one for each) at `start`."""
        if self._sums is None:
            h = self.hashes()
            up, self._down = _OF_WORDS.get(len(h) + 1)
            self._sums = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * up[:-1], out=self._sums[1:])
        h = (self._sums[start + length] - self._sums[start]) * self._down[start]
        return mix(h + np.asarray(length, np.uint64) * np.uint64(0xA24BAED4963EE407))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most about `limit` bytes; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def each_chunk(schema: pa.Schema, make: Callable, text: str = "text", lower: bool = False, breaks: np.ndarray = _SPACE) -> Callable:
    """A mapInArrow function: `make(batch slice, Words)` gives the columns of each chunk of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in chunks(batch.column(batch.schema.get_field_index(text))):
                columns = make(batch.slice(at, end - at), Words(data, offsets, lower, breaks))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema, strict=True)],
                    schema=schema,
                )

    return run


def each_text(schema: pa.Schema, make: Callable, text: str = "text", keep: tuple = ("doc_id",), rows: int = 256) -> Callable:
    """A mapInArrow function: `make(text)` gives a tuple for each row, put after the columns in `keep`; null is ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                made = [make(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                columns += [pa.array(c, schema.field(len(keep) + k).type) for k, c in enumerate(zip(*made, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run
