"""Helpers for Arrow batches of texts: words as views on the batch's own bytes, and 64-bit hashes.

Everything here works on one batch at a time, so memory is bounded by the batch (and by the
longest single text, which is always held whole).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Space and \x09-\x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(batches: Iterable[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, so that wide rows do not pile up."""
    for batch in batches:
        column = batch.column(text)
        size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class Texts:
    """The bytes of a column of texts (null: empty), one after another."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
        self.offsets = offsets.astype(np.int64)
        data = column.buffers()[2]
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bytes = whole[self.offsets[0] : self.offsets[-1]]
        self.offsets = self.offsets - self.offsets[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> Texts:
        """The same texts with A-Z as a-z."""
        other = Texts.__new__(Texts)
        other.offsets, other.bytes = self.offsets, LOWER[self.bytes]
        return other


class Words:
    """Words (maximal runs of bytes that are no ``gap``: by default other than space and \\x09-\\x0D) of texts: start, stop,
    and the first word of each text."""

    def __init__(self, texts: Texts, gap: np.ndarray = IS_SPACE):
        self.texts = texts
        space = gap[texts.bytes]
        edge = np.ones(len(space) + 1, dtype=bool)
        edge[:-1] = space
        before = np.ones(len(space) + 1, dtype=bool)
        before[1:] = space
        # A text's first byte opens a word whatever ends the text before it, and its end shuts one.
        inner = texts.offsets[1:-1]
        opens = ~edge[:-1] & before[:-1]
        inner = inner[inner < len(space)]
        opens[inner] = ~space[inner]
        shuts = np.zeros(len(space) + 1, dtype=bool)
        shuts[1:] = ~space & edge[1:]
        cut = texts.offsets[1:]
        cut = cut[cut > 0]
        shuts[cut] |= ~space[cut - 1]
        self.start = np.flatnonzero(opens)
        self.stop = np.flatnonzero(shuts)
        self.first = np.searchsorted(self.start, texts.offsets)

    def __len__(self) -> int:
        return len(self.start)

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """(code of each word, the distinct words by code)."""
        return coded(self.texts.bytes, self.start, self.stop)

    def hashed(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        codes, distinct = self.coded()
        return hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)


def coded(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Dictionary-encode the slices data[start:stop]; gaps between slices are skipped."""
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    # Alternate slice and gap in one array over the same bytes, then keep the slices.
    bounds = np.empty(2 * len(start) + 1, dtype=np.int64)
    bounds[0:-1:2], bounds[1:-1:2], bounds[-1] = start, stop, len(data)
    both = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), 2 * len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]
    )
    kept = both.take(pa.array(np.arange(0, 2 * len(start), 2)))
    encoded = kept.dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary


def hashes(values: pa.Array) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, values.to_numpy(zero_copy_only=False)), dtype=np.uint64, count=len(values))


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` hashed values; empty when there are fewer."""
    count = len(values) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(size):
        out *= _GOLDEN
        out += values[i : i + count]
    return mix(out)
