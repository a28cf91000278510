"""Benchmark decontamination by the q-gram lemma.

Texts and items are compared as UTF-8 bytes in lower case with white space runs as one space. An item of m
bytes may differ by e edits, a fixed share of m. Each edit spoils at most q of its m - q + 1
q-grams, so a region within the budget keeps at least m - q + 1 - q * e of them, on diagonals (place in the text
minus place in the item) at most e apart. Shared q-grams are therefore counted in bands of
diagonals twice as wide as that and half overlapping; bands that reach the bound are kept and verified by a
banded alignment of the whole item. Items of 8 bytes and more have grams of 8 bytes, or of the most that leave the bound above zero
(m // (e + 1)), so the bound is exact: nothing within the budget is missed.

Grams that text and item share are expanded in slices of bounded size, and a band is counted once no later slice can add to it, so a
text of one repeated character costs time but no memory. Equal windows of a text are aligned once.

Items are few against documents and are broadcast in blocks of limited size. One block is a step over the rows: no shuffle, no join, and
no row leaves its partition. More blocks are searched one job after the other, each for the texts that hold something of it; what
they find meets the rows by the text's SHA-256. The driver holds one block at a time.

Defined results: items longer than ``SEGMENT`` bytes are found by any of their half-overlapping segments; an item shorter than 8 bytes
only counts if it is the whole text; empty or null items are never found; a null or empty text holds nothing; items
of equal id count as one, items without an id are left out; repeated rows get equal
results; all columns are kept, and one named like the result is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.llm.batches import IS_SPACE, Texts, pieces
from tierwalk.workspace import Workspace

Q, RATE, SEGMENT = 8, 0.08, 400
#: Bytes of items in a block, and pairs of a place in a text and one in an item that are held at a time.
BLOCK_BYTES, PAIRS, RUN = 16 << 20, 500_000, 4096
_BITS = 22
_ODD = np.uint64(0x9E3779B97F4A7C15)

HITS = "array<struct<item_id:bigint,edits:int>>"


def normal(column: pa.Array) -> Texts:
    texts = Texts(pc.utf8_lower(pc.fill_null(column, "")))
    space = IS_SPACE[texts.bytes]
    keep = np.ones(len(space), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    inner = texts.offsets[:-1][np.diff(texts.offsets) > 0]
    keep[inner] = True
    out = Texts.__new__(Texts)
    out.bytes = np.where(space, np.uint8(32), texts.bytes)[keep]
    out.offsets = np.append(0, np.cumsum(keep))[texts.offsets]
    return out


def grams(data: np.ndarray, size: int = Q) -> np.ndarray:
    """The ``size`` bytes (8 at most) from each place as one number; beyond the end come zeros."""
    padded = np.append(data, np.zeros(2 * Q, np.uint8))
    out = np.empty(len(data), np.uint64)
    for s in range(min(Q, len(data))):
        n = len(out[s::Q])
        out[s::Q] = padded[s : s + n * Q].view("<u8")
    return out & np.uint64((1 << 8 * size) - 1)


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys * _ODD) >> np.uint64(64 - _BITS)


@dataclass(frozen=True)
class Index:
    """Segments of items with grams of one size, and these grams: keys ascending, with the (segment, place) pairs of each."""

    size: int
    ids: np.ndarray  # item of each segment
    texts: list[bytes]
    edits: np.ndarray
    needed: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    segment: np.ndarray
    place: np.ndarray
    table: np.ndarray


@dataclass(frozen=True)
class Block:
    """Indexes by gram size, and items that are shorter than any gram."""

    indexes: list[Index]
    short: dict[bytes, list[int]]


def index(ids: np.ndarray, column: pa.Array, rate: float = RATE) -> Block:
    texts = normal(column)
    owners, segments, short = [], [], {}
    for item, a, b in zip(ids.tolist(), texts.offsets[:-1], texts.offsets[1:], strict=True):
        text = texts.bytes[a:b].tobytes().strip(b" ")
        if len(text) < Q:
            if text:
                short.setdefault(text, []).append(item)
            continue
        starts = range(0, max(1, len(text) - SEGMENT // 2), SEGMENT // 2) if len(text) > SEGMENT else (0,)
        for s in starts:
            s = min(s, max(0, len(text) - SEGMENT))
            owners.append(item)
            segments.append(text[s : s + SEGMENT])
    by_size: dict[int, list[int]] = {}
    for n, segment in enumerate(segments):
        by_size.setdefault(min(Q, len(segment) // (int(rate * len(segment)) + 1)), []).append(n)
    indexes = [_index(q, [owners[n] for n in some], [segments[n] for n in some], rate) for q, some in sorted(by_size.items()) if q]
    return Block(indexes, short)


def _index(q: int, owners: list[int], segments: list[bytes], rate: float) -> Index:
    size = np.array([len(s) for s in segments], np.int64)
    edits = (rate * size).astype(np.int64)
    found = [grams(np.frombuffer(s, np.uint8), q)[: len(s) - q + 1] for s in segments]
    keys = np.concatenate(found)
    segment = np.repeat(np.arange(len(found)), [len(f) for f in found])
    place = np.concatenate([np.arange(len(f)) for f in found])
    order = np.argsort(keys, kind="stable")
    unique, first = np.unique(keys[order], return_index=True)
    table = np.zeros(1 << _BITS, bool)
    table[_slot(unique)] = True
    needed = size - q + 1 - q * edits
    return Index(q, np.array(owners, np.int64), segments, edits, needed, unique, np.append(first, len(keys)), segment[order], place[order], table)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, limit: int) -> int:
    """Least edits between the item and a part of the text on diagonals low to high; limit + 1 if there are more."""
    width = high - low + 1
    padded = np.full(len(item) + width, 256, np.int16)  # no byte
    a, b = max(low, 0), min(low + len(padded), len(text))
    if b > a:
        padded[a - low : b - low] = text[a:b]
    steps = np.arange(width)
    row = np.zeros(width, np.int64)
    for i, byte in enumerate(item.tolist()):
        new = row + (padded[i : i + width] != byte)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > limit:
            return limit + 1
    return int(row.min())


def _expanded(ix: Index, rank: np.ndarray, times: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number in rank, segment, place) of shared grams in order, in slices of about ``PAIRS`` if each counts ``times``."""
    width = ix.first[rank + 1] - ix.first[rank]
    total = np.cumsum(width * times)
    start = 0
    while start < len(rank):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + PAIRS, side="right")))
        w, r = width[start:stop], rank[start:stop]
        pair = np.repeat(ix.first[r] - np.cumsum(w) + w, w) + np.arange(int(w.sum()))
        yield np.repeat(np.arange(start, stop), w), ix.segment[pair], ix.place[pair]
        start = stop


def _sums(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the same keys added up."""
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, counts, len(unique)).astype(np.int64)


def _bands(texts: Texts, ix: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, segment, band) that share as many grams as the bound asks."""
    nothing = (np.zeros(0, np.int64),) * 3
    keys = grams(texts.bytes, ix.size)
    at = np.flatnonzero(ix.table[_slot(keys)])
    rank = np.minimum(np.searchsorted(ix.keys, keys[at]), len(ix.keys) - 1)
    known = ix.keys[rank] == keys[at]
    at, rank = at[known], rank[known]
    owner = np.searchsorted(texts.offsets, at, side="right") - 1
    inside = at + ix.size <= texts.offsets[owner + 1]
    at, rank, owner = at[inside], rank[inside], owner[inside]
    if not len(at):
        return nothing
    n = len(ix.ids)
    # A text and a segment that share too few grams anywhere need no bands.
    text, gram = np.divmod(np.unique(owner * len(ix.keys) + rank), len(ix.keys))
    parts = [np.unique(text[i] * n + segment, return_counts=True) for i, segment, _ in _expanded(ix, gram, np.ones_like(gram))]
    both, total = _sums(parts)
    both = both[total >= ix.needed[both % n]]
    if not len(both):
        return nothing
    span = int(np.diff(texts.offsets).max()) + 2 * SEGMENT + 2
    # One gram at places in a row is one run: a character repeated, cut to limited lengths.
    new_run = np.append(True, (np.diff(at) != 1) | (np.diff(rank) != 0) | (np.diff(owner) != 0) | (at[1:] % RUN == 0))
    first = np.flatnonzero(new_run)
    run = np.diff(np.append(first, len(at)))
    at, rank, owner = at[first], rank[first], owner[first]
    # Keys are (text, segment, band, place of the item); a place counts once in a band.
    open_keys, out = np.zeros(0, np.int64), []
    for i, segment, place in _expanded(ix, rank, run):
        pair = owner[i] * n + segment
        spot = np.minimum(np.searchsorted(both, pair), len(both) - 1)
        enough = both[spot] == pair
        i, segment, place, pair = i[enough], segment[enough], place[enough], pair[enough]
        here, step = at[i] - texts.offsets[owner[i]], ix.edits[segment] + 1
        low, high = ((here + further - place + SEGMENT) // step for further in (0, run[i] - 1))
        wide = high - low + 1
        band = np.repeat(low - np.cumsum(wide) + wide, wide) + np.arange(int(wide.sum()))
        place, pair = np.repeat(place, wide), np.repeat(pair, wide)
        # Band b has diagonals from (b - 1) * step to (b + 1) * step.
        new = np.concatenate([(pair * span + band + 1) * SEGMENT + place, (pair * span + band) * SEGMENT + place])
        open_keys = np.union1d(open_keys, new)
        if len(i):
            # Later places in the text lie on diagonals from here on.
            pairs, bands = np.divmod(open_keys // SEGMENT, span)
            text, seg = np.divmod(pairs, n)
            done = (text < owner[i[-1]]) | (bands < here[-1] // (ix.edits[seg] + 1))
            out.append(_reached(open_keys[done], ix, n, span))
            open_keys = open_keys[~done]
    out.append(_reached(open_keys, ix, n, span))
    pairs, bands = np.divmod(np.unique(np.concatenate(out)), span)
    return pairs // n, pairs % n, bands


def _reached(keys: np.ndarray, ix: Index, n: int, span: int) -> np.ndarray:
    """The (text, segment, band) among complete keys that reach the bound."""
    key, shared = np.unique(keys // SEGMENT, return_counts=True)
    return key[shared >= ix.needed[key // span % n]]


def search(texts: Texts, block: Block) -> list[tuple[int, int, int]]:
    """(text, item, edits) for each item found in each text."""
    data, out = texts.bytes, {}
    if block.short:
        for row, (a, b) in enumerate(zip(texts.offsets[:-1], texts.offsets[1:], strict=True)):
            if b - a < Q + 2:
                for item in block.short.get(data[a:b].tobytes().strip(b" "), ()):
                    out[row, item] = 0
    for ix in block.indexes if len(data) else ():
        aligned: dict[tuple, int] = {}
        for row, s, band in zip(*(c.tolist() for c in _bands(texts, ix)), strict=True):
            item, limit, segment = int(ix.ids[s]), int(ix.edits[s]), ix.texts[s]
            if out.get((row, item), limit + 1) == 0:
                continue
            text = data[texts.offsets[row] : texts.offsets[row + 1]]
            low = (band - 1) * (limit + 1) - SEGMENT - limit
            high = low + 2 * (limit + 1) - 1 + 2 * limit
            begin = max(low, 0)
            near = text[begin : max(high + len(segment), 0)]
            window = (s, low - begin, near.tobytes())
            if window not in aligned:
                if len(aligned) > 10_000:
                    aligned.clear()
                aligned[window] = 0 if segment in window[2] else align(np.frombuffer(segment, np.uint8), near, low - begin, high - begin, limit)
            edits = aligned[window]
            if edits <= limit:
                out[row, item] = min(edits, out.get((row, item), edits))
    return [(r, i, e) for (r, i), e in sorted(out.items())]


def find(docs: DataFrame, items: DataFrame, rate: float = RATE, hits: str = "hits", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """All rows and columns of docs with ``hits``: the items found in each text and the edits of the best place."""
    items = items.select(F.col(item_key).cast("long").alias("id"), F.col(item_text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = 1 if size <= BLOCK_BYTES else 2 * (size // BLOCK_BYTES + 1)
    docs = docs.drop(hits)
    if blocks == 1:
        return _step(docs.withColumn(hits, F.array().cast(HITS)), _collected(items, rate), hits, text)[0]
    space = Workspace(docs.sparkSession, "decontam")
    texts = docs.select(F.col(text).alias("text")).withColumn("hits", F.array().cast(HITS))
    names = []
    for b in range(blocks):
        found, shared = _step(texts, _collected(items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b), rate), "hits", "text")
        found = found.where(F.size("hits") > 0).select(F.unhex(F.sha2("text", 256)).alias("digest"), F.explode("hits").alias("hit"))
        best = found.groupBy("digest", "hit.item_id").agg(F.min("hit.edits").alias("edits"))
        names.append(f"block-{b}")
        space.write(best, names[-1])
        shared.destroy()
    best = space.read(best.schema, *names).groupBy("digest", "item_id").agg(F.min("edits").alias("edits"))
    lists = best.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("item_id", "edits"))).cast(HITS).alias("_tierwalk_hits"))
    own = "_tierwalk_digest"
    joined = docs.withColumn(own, F.unhex(F.sha2(F.col(text), 256))).join(lists.withColumnRenamed("digest", own), own, "left")
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.coalesce("_tierwalk_hits", F.array().cast(HITS)).alias(hits))


def _collected(items: DataFrame, rate: float) -> Block:
    """The index of a block of items, whose bytes are bounded."""
    block = items.toArrow().combine_chunks()
    texts = block.column(1).combine_chunks() if block.num_rows else pa.array([], pa.string())
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    return index(block.column(0).to_numpy(), texts, rate)


def _step(docs: DataFrame, block: Block, hits: str, text: str) -> tuple[DataFrame, Broadcast]:
    shared = docs.sparkSession.sparkContext.broadcast(block)
    at, last = docs.columns.index(text), len(docs.columns) - 1
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            found = search(normal(batch.column(at)), shared.value)
            lists = batch.column(last).to_pylist()
            for row, item, edits in found:
                best = {h["item_id"]: h["edits"] for h in lists[row]}
                best[item] = min(edits, best.get(item, edits))
                lists[row] = [{"item_id": i, "edits": e} for i, e in sorted(best.items())]
            yield pa.record_batch([*batch.columns[:last], pa.array(lists, kind)], names=batch.schema.names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, fields), shared
