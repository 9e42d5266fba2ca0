"""Byte-level text kernels over Arrow string columns: no Python string is made per word.

Words are runs of bytes other than ``\\x20`` and ``\\x09-\\x0D`` (the ASCII white space), after
A-Z has been lower-cased; in UTF-8 this equals the same rule on code points. A word is its
64-bit hash: a polynomial over random byte values modulo 2**64, with the length, mixed.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER_BYTE = _BYTE[LOWER]
#: Powers are products of two: one below so many, and a multiple of it. Tables of all powers up to a text's length would stay in each worker.
_LOW = 1 << 12


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def salt(n: int) -> np.uint64:
    """The ``n``-th of a fixed sequence of well spread 64-bit numbers."""
    return U(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def _first_powers(base: np.uint64 | np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base`` to the powers 0 .. ``_LOW`` - 1, and to their multiples of ``_LOW`` below ``n``."""
    low = _first_powers(base, _LOW)
    return low, _first_powers(low[-1:] * base, -(-n // _LOW))


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and each kept what its largest task had taken."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The Arrow mapper ``run``, before and after which the worker returns freed memory."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what a grouped function's tables took is free only now
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the rows' offsets in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # nothing in it, or more than one chunk can hold
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks] or [pa.array([], pa.large_string())])
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each (one row at least)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the rows' offsets in them."""
    word = ~SPACE[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begins[first] = word[first]
    ends[last] = word[last]
    begins = np.flatnonzero(begins)
    return begins, np.flatnonzero(ends) + 1, np.searchsorted(begins, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased words' 64-bit hashes in order, and the rows' offsets in them."""
    begins, ends, rows = word_spans(data, offsets)
    if not len(begins):
        return np.zeros(0, np.uint64), rows
    n = len(data)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.take(_LOWER_BYTE, data, out=sums[1:])
    low, high = _powers(_BASE, n)
    whole = n // _LOW * _LOW
    blocks = sums[1 : whole + 1].reshape(-1, _LOW)
    blocks *= low
    blocks *= high[: len(blocks), None]
    sums[whole + 1 :] *= low[: n - whole] * high[-1]
    np.cumsum(sums[1:], out=sums[1:])
    low, high = _powers(_INVERSE, n)
    out = (sums[ends] - sums[begins]) * low[begins % _LOW] * high[begins // _LOW]
    out += (ends - begins).astype(np.uint64) * U(0xD6E8FEB86659FD93)
    return mix(out), rows


def chain(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    """The hash of a sequence one longer, from its first part's hash and its last word's."""
    return mix((left ^ U(salt)) * U(0xC2B2AE3D27D4EB4F) + right * U(0x165667B19E3779F9))


def shingles(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' distinct k-word shingle hashes, ascending, and the rows' offsets in them.

    A row of fewer words has the whole sequence as its one shingle, a row without words none.
    """
    n = len(rows) - 1
    counts = np.diff(rows)
    total = len(words)
    if total:
        grams = words
        for step in range(1, k):
            if total > step:
                grams = np.concatenate([chain(grams[: total - step], words[step:], 0x51 + step), np.zeros(step, np.uint64)])
    else:
        grams = words
    out, sizes = [], np.zeros(n, np.int64)
    for i in range(n):
        c = counts[i]
        if c >= k:
            g = np.sort(grams[rows[i] : rows[i] + c - k + 1])
            if len(g) > 1:
                keep = np.empty(len(g), bool)
                keep[0] = True
                np.not_equal(g[1:], g[:-1], out=keep[1:])
                g = g[keep]
        elif c:
            g = words[rows[i] : rows[i] + 1]
            for step in range(1, c):
                g = chain(g, words[rows[i] + step : rows[i] + step + 1], 0x51 + step)
            g = mix(g + U(c))
        else:
            continue
        out.append(g)
        sizes[i] = len(g)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array | pa.ChunkedArray:
    return batch.column(batch.schema.get_field_index(name))
