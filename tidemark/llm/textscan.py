"""Vectorised scanning of a batch of texts (NumPy, used inside Spark tasks).

A batch is one byte buffer with document offsets, taken from Arrow without a
copy. Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``. Words and
longer strings are compared by 64-bit polynomial hashes over a random byte
table; hashing works in blocks, so that memory follows the block, not the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_U = np.uint64
_RNG = np.random.default_rng(20240229)
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
BASE = int(_RNG.integers(1, 2**61)) * 8 + 5
INVERSE = pow(BASE, -1, 2**64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (kept for the next call)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 4096)
        have = np.full(size, base % 2**64, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the word."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def batch_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside``; a run ends with its document."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[0] = first[n] = True
    first[offsets[(offsets >= 0) & (offsets <= n)]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of every document."""
    return runs(~SPACE[buf], offsets)


def per_document(starts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document of each run, runs before each document; length n + 1)."""
    bounds = np.searchsorted(starts, offsets)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)), bounds


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """A 64-bit hash of each of the sorted spans."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        low = int(starts[k])
        stop = max(k + 1, int(np.searchsorted(ends, low + BLOCK_BYTES, "right")))
        high = int(ends[stop - 1])
        size = high - low
        up, down = powers(BASE, size), powers(INVERSE, size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(codes[buf[low:high]] * up[:size], out=sums[1:])
        a, b = starts[k:stop] - low, ends[k:stop] - low
        out[k:stop] = mix((sums[b] - sums[a]) * down[np.minimum(a, size - 1)] + (b - a).astype(np.uint64))
        k = stop
    return out


def counts_between(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags each document has."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def shingles(hashes: np.ndarray, document: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run of ``k`` words of one document."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * _U(BASE) + hashes[i : i + n]
    keep = np.flatnonzero(document[:n] == document[k - 1 :])
    return keep, mix(h[keep])


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
