"""Words, shingles and sentences of whole Arrow string columns as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame

# Small enough for arrays of 8 bytes per byte of text to stay in a core's cache.
SLICE_BYTES = 1 << 18
SLICE_ROWS = 4096
LONG_WORD = 64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}

# White space of the word rule [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        out = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        out[0] = 1
        known = np.cumprod(out)
        if n <= 32 * SLICE_BYTES:  # do not keep what one very long text needed
            _powers[base] = known
    return known[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each starts; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(at) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about ``most`` bytes of text; a longer text stands alone."""
    _, at = buffers(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < len(batch):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        stop = min(stop, start + SLICE_ROWS, len(batch))
        yield batch.slice(start, stop - start)
        start = stop


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """All columns and a last one, under a name of its own, with the text that tasks read."""
    name = "_text"
    while name in docs.columns:
        name += "_"
    return docs.select(*[docs[c] for c in docs.columns], text.alias(name))


def last_column(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(batch.num_columns - 1)], ["_text"])


class Words:
    """The words of several texts: 64-bit hash, byte span, and the row each belongs to."""

    def __init__(self, data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE, fold: np.ndarray | None = None):
        n = len(data)
        inside = np.zeros(n + 1, bool)
        inside[:n] = ~space[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut = at[:-1][at[:-1] < n]
        first[cut] = inside[cut]
        self.start = np.flatnonzero(first)
        # a word ends before the next white space or the next text
        last = inside[:n].copy()
        last[:-1] &= ~inside[1:n] | first[1:n]
        self.end = np.flatnonzero(last) + 1
        values = (_BYTE if fold is None else _BYTE[fold])[data]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _power(_BASE, n), out=total[1:])
        inverse = _power(_BASE_INV, n)
        h = (total[self.end] - total[self.start]) * inverse[self.start] if n else np.zeros(0, np.uint64)
        self.hash = mix(h + (self.end - self.start).astype(np.uint64))
        # A polynomial modulo 2^64 is known to fail on long patterned strings: those get another hash.
        for i in np.flatnonzero(self.end - self.start > LONG_WORD).tolist():
            whole = data[self.start[i] : self.end[i]] if fold is None else fold[data[self.start[i] : self.end[i]]].astype(np.uint8)
            self.hash[i] = xxhash.xxh64_intdigest(whole.tobytes())
        #: words of row i are bounds[i]:bounds[i + 1]
        self.bounds = np.searchsorted(self.start, at)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` values starting at each position (``len(h) - k + 1`` of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[i : i + n]
    return mix(out)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every ``k``-word shingle that lies in one text.

    A text of 1 to k-1 words has one shingle: all its words.
    """
    g, rows, size = grams(words.hash, k), words.rows(), np.diff(words.bounds)
    if len(g):
        inside = rows[: len(g)] == rows[k - 1 :]
        g, r = g[inside], rows[: len(inside)][inside]
    else:
        r = np.zeros(0, np.int64)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        whole = np.array([grams(words.hash[words.bounds[i] : words.bounds[i + 1]], int(size[i]))[0] for i in short], np.uint64)
        g, r = np.concatenate([g, whole]), np.concatenate([r, short])
        order = np.argsort(r, kind="stable")
        g, r = g[order], r[order]
    return g, r
