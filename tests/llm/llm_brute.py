"""Plain Python versions of what the operators of tierwalk.llm return."""

from __future__ import annotations

import re
from collections import Counter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, size: int) -> frozenset:
    words = WORDS.findall((text or "").translate(LOWER))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near_duplicates(rows: list[tuple], size: int, percent: int) -> list[tuple]:
    """(id, n_shingles, component, kept) per row of (id, text)."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return [(i, len(s), top(i), i == top(i)) for i, s in sets]


def cut_words(rows: list[tuple], window: int) -> list[tuple]:
    """(id, n_words, n_removed, kept words) per row."""
    texts = [(i, WORDS.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in texts for k in range(len(w) - window + 1))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def drop_bytes(rows: list[tuple], window: int) -> list[tuple]:
    """(id, n_bytes, n_removed, n_spans, kept) per row."""
    first: dict[bytes, int] = {}
    for i, t in rows:
        data = (t or "").encode()
        for k in range(len(data) - window + 1):
            if i is not None:
                first[data[k : k + window]] = min(i, first.get(data[k : k + window], i))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - window + 1):
            if i is not None and first[data[k : k + window]] < i:
                gone[k : k + window] = b"\x01" * window
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), sum(gone), len(re.findall(b"\x01+", bytes(gone))), kept))
    return out


def edits(item: bytes, text: bytes) -> int:
    """Least edits between item and any part of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)
