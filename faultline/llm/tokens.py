"""Word hashes of whole Arrow string columns, without a Python object for each word.

A word is a maximal run of bytes other than space, \\t, \\n, \\v, \\f and \\r; no other UTF-8
sequence holds those bytes. The hash of a word is a sum over its bytes, each looked up in a
table of random 64-bit numbers and multiplied by a power of an odd base; the sums are
differences of running totals modulo 2**64. It depends on the word alone, so it is the same
in every process and batch.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; longer texts are cut at white space.
SEGMENT = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit of the result depends on all bits of x."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: none) and where each text begins, with the end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, starts, data = column.buffers()
    at = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def spans(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in body, and for each text the index of its first word, with the count."""
    solid = ~_SPACE[body]
    first = np.zeros(len(body) + 1, bool)
    first[at] = True
    before = np.concatenate([[False], solid[:-1]]) if len(body) else np.zeros(0, bool)
    after = np.concatenate([solid[1:], [False]]) if len(body) else np.zeros(0, bool)
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def hashed(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of body; with lower, A-Z count as a-z."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    table = _TABLE[_LOWER] if lower else _TABLE
    while i < len(starts):
        j = int(max(i + 1, np.searchsorted(ends, starts[i] + SEGMENT, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        size = SEGMENT if hi - lo <= SEGMENT else 1 << int(hi - lo - 1).bit_length()
        up, down = _powers(size)
        run = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[body[lo:hi]] * up[: hi - lo], out=run[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def words(column: pa.Array | pa.ChunkedArray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts in order, and for each text the index of its first word, with the count."""
    body, at = flat(column)
    starts, ends, first = spans(body, at)
    return hashed(body, starts, ends, lower), first


def word_hash(word: str, lower: bool = True) -> int:
    """The hash of one word, as words() gives it."""
    h, _ = words(pa.array([word]), lower)
    return int(h[0])
