"""Blocks: the windows of a token sequence, grouped by the gram that stands for them.

Every window of ``length`` tokens picks the least hashed of its grams of ``gram`` tokens (the leftmost of
equals). The choice depends on the window alone, so equal windows pick the same gram at the same
place. Windows next to each other mostly pick the same one; such a run of windows is a block. About one block begins per
(length - gram + 2) / 2 tokens, so blocks can be counted across a corpus where windows cannot. Equal
blocks hold equal windows, and two equal windows lie in blocks with the same gram.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tierwalk.llm.batches import mix

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


class RangeHash:
    """64-bit hashes of ranges of 64-bit token values, by sums of value * base ** place."""

    def __init__(self, values: np.ndarray):
        powers = np.full(len(values) + 1, _BASE, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers[:-1], out=self.sums[1:])
        self.back = np.full(len(values) + 1, _INVERSE, np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64) * _LENGTH)

    def runs(self, size: int) -> np.ndarray:
        """Of every run of ``size`` values."""
        n = max(len(self.sums) - size, 0)
        return mix((self.sums[size:] - self.sums[:n]) * self.back[:n] + np.uint64(size * int(_LENGTH) & (1 << 64) - 1))


@dataclass(frozen=True)
class Blocks:
    """first, last: first tokens of the first and last window; gram and value: hashes of gram and block."""

    hashes: RangeHash
    first: np.ndarray
    last: np.ndarray
    gram: np.ndarray
    value: np.ndarray


def inside(offsets: np.ndarray, n: int, length: int) -> np.ndarray:
    """Whether the window from each of the n - length + 1 places lies in one text."""
    count = max(n - length + 1, 0)
    cut = offsets[1:-1]
    change = np.bincount(np.clip(cut - length + 1, 0, count), minlength=count + 1).astype(np.int64)
    change -= np.bincount(np.clip(cut, 0, count), minlength=count + 1)
    return np.cumsum(change)[:count] <= 0


def blocks(values: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Blocks:
    """Of texts whose tokens are values[offsets[i]:offsets[i + 1]]."""
    hashes, n = RangeHash(values), len(values)
    grams = hashes.runs(gram)
    if n < length:
        none = np.zeros(0, np.int64)
        return Blocks(hashes, none, none, none.astype(np.uint64), none.astype(np.uint64))
    bits = np.uint64(n.bit_length())
    least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - width + span], least[width - span :])
    pick = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = np.flatnonzero(inside(offsets, n, length))
    pick = pick[at]
    begins = np.flatnonzero(np.append(True, (pick[1:] != pick[:-1]) | (at[1:] != at[:-1] + 1))) if len(at) else at
    first, last = at[begins], at[np.append(begins[1:], len(at)) - 1] if len(at) else at
    pick = pick[begins]
    value = mix(hashes.of(first, last + length) + (pick - first).astype(np.uint64) * _LENGTH)
    return Blocks(hashes, first, last, grams[pick], value)


def ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after another."""
    size = stop - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def covered(n: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the ranges."""
    change = np.bincount(start, minlength=n + 1).astype(np.int64)
    change -= np.bincount(stop, minlength=n + 1)
    return np.cumsum(change)[:n] > 0
