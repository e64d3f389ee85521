"""Golomb-Rice codes of sorted distinct numbers (NumPy, used inside Spark tasks).

A list is coded as the steps between its numbers. A step's low ``k`` bits are
stored as they are, the rest in unary: as many ones, then a zero. With ``k`` near
the logarithm of the mean step, a list of n numbers below u takes some
n * (log2(u / n) + 1.5) bits.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<IBQ")
_U = np.uint64


def parameter(steps: np.ndarray) -> int:
    """The bits stored as they are: the logarithm of 0.69 of the mean step."""
    mean = float(steps.mean()) if len(steps) else 0.0
    return max(0, int(np.ceil(np.log2(0.69 * mean)))) if mean > 1.5 else 0


def encode(numbers: np.ndarray) -> bytes:
    """Sorted distinct unsigned numbers: count, k, the first, low bits, unary bits."""
    numbers = np.asarray(numbers, _U)
    if not len(numbers):
        return _HEAD.pack(0, 0, 0)
    steps = np.diff(numbers) - _U(1)
    k = min(parameter(steps), 56)
    low = steps & _U((1 << k) - 1)
    shifts = np.arange(k - 1, -1, -1, dtype=_U)
    fixed = ((low[:, None] >> shifts) & _U(1)).astype(np.uint8)
    high = (steps >> _U(k)).astype(np.int64)
    unary = np.ones(int(high.sum()) + len(high), np.uint8)
    unary[np.cumsum(high + 1) - 1] = 0
    return _HEAD.pack(len(numbers), k, int(numbers[0])) + np.packbits(fixed.reshape(-1)).tobytes() + np.packbits(unary).tobytes()


def decode(data: bytes) -> np.ndarray:
    n, k, first = _HEAD.unpack_from(data)
    if not n:
        return np.zeros(0, _U)
    m = n - 1
    middle = _HEAD.size + (m * k + 7) // 8
    fixed = np.unpackbits(np.frombuffer(data[_HEAD.size : middle], np.uint8), count=m * k).reshape(m, k)
    low = np.zeros(m, _U)
    for i in range(k):
        low = (low << _U(1)) | fixed[:, i].astype(_U)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data[middle:], np.uint8)) == 0)[:m]
    high = np.diff(np.concatenate([[-1], ends])) - 1
    steps = (high.astype(_U) << _U(k)) + low + _U(1)
    return np.concatenate([[_U(first)], steps]).cumsum(dtype=_U)
