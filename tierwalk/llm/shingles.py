"""Word shingle sets of texts and their min-hash sketches, a batch at a time."""

from __future__ import annotations

import numpy as np
import xxhash

from tierwalk.llm.batches import Texts, Words, mix, windows

#: Minima of a signature: BANDS bands of ROWS.
BANDS, ROWS = 32, 4
N_MINIMA = BANDS * ROWS


def universal_hashes(n: int, seed: int = 20240607) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of n multiply-shift hash functions of 64-bit values."""
    i = np.arange(n, dtype=np.uint64)
    a = mix(i * np.uint64(2) + np.uint64(seed)) | np.uint64(1)
    return a, mix(i * np.uint64(2) + np.uint64(seed + 1))


def shingle_sets(texts: Texts, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text, as ascending 64-bit hashes.

    A text with fewer words is one shingle, one without words has none.
    """
    words = Words(texts.lower())
    values = words.hashed()
    runs = windows(values, size)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(windows(values[a:b], b - a) + np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit hashes of each set, as a row."""
    digests = b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets)
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


def signatures(sets: list[np.ndarray], block: int = 1 << 16) -> np.ndarray:
    """The minimum of each universal hash over each set (empty sets: all zero), as rows."""
    a, b = universal_hashes(N_MINIMA)
    out = np.zeros((len(sets), N_MINIMA), np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(some):
        stop, total = at, 0
        while stop < len(some) and (stop == at or total + len(sets[some[stop]]) <= block):
            total += len(sets[some[stop]])
            stop += 1
        rows = some[at:stop]
        values = np.concatenate([sets[i] for i in rows])
        lengths = np.array([len(sets[i]) for i in rows])
        first = np.cumsum(lengths) - lengths
        for j in range(N_MINIMA):
            out[rows, j] = np.minimum.reduceat((values * a[j] + b[j]) >> np.uint64(32), first)
        at = stop
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per text and band; equal where all minima of the band are equal."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two shingle sets; empty sets are linked with nothing."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
