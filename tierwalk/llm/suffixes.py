"""Byte-level dedup by a suffix order that is only as deep as the threshold.

1. A cut, by blocks of suffixes (see ``anchors``): all windows in a row that share their least hashed gram are one entry. Entries
are dealt to partitions by gram. What lies under a gram of one document only occurs nowhere else and is done. Blocks
equal as a whole are settled: one of them, in the first document, stands for all, and whoever holds another drops it.
2. The order, of what is left: different blocks under one gram of several documents. Their bytes travel to the partition of their
gram, where every suffix that starts a window is ordered by passes over its bytes, most significant digit first, eight bytes a digit. After
each pass a group is followed only while it holds several documents, and no pass goes beyond the threshold, so the groups
left in the end are exactly the repeated windows.

A gram with very many different blocks hands out its windows one by one, dealt by window instead of by gram, so
that no partition gets all of them.

Entries travel as packed arrays, one row per batch and partition, and each document's shard is told just
what concerns it. Shards and partitions grow in number with the corpus and not in size.

Defined results: a null or empty text has no bytes; a null id neither drops nor makes others drop anything; ids are whole numbers (others raise); rows of one
id are one document, so they drop nothing because of each other; texts shorter than the threshold stay whole; what is kept is bytes, as a cut may
fall inside a character; all columns are kept, and added columns replace ones of the same name; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.llm.anchors import Blocks, RangeHash, blocks, covered, inside, ranges
from tierwalk.llm.batches import Texts, mix, pieces
from tierwalk.workspace import Workspace

#: Bytes of a window, of a gram, and of text in a shard or batch, which takes a hundred times as much while it is hashed.
WINDOW, GRAM, SHARD_BYTES = 50, 20, 2 << 20

#: Shards whose entries meet in one partition of the order, bytes of a digit, and different blocks up to which a gram is one key.
SHARDS_PER_PART, DIGIT, HOT = 4, 8, 20_000

#: Byte values as 64-bit tokens.
_TOKENS = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))

SETTLED, PROBED, SINGLE, SPLIT = 1, 2, 3, 4
_REPLY = "shard int, kind int, value bigint, first bigint"
_BLOCKS = "part int, shard int, sizes binary, docs binary, data binary"


def _blocks(texts: Texts, window: int, gram: int) -> tuple[Blocks, np.ndarray]:
    """Blocks and the text each lies in."""
    found = blocks(_TOKENS[texts.bytes], texts.offsets, window, gram)
    return found, np.searchsorted(texts.offsets, found.first, side="right") - 1


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _packed(part: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row (part, payload) per part, the columns of its entries one after another; entries are ordered by part."""
    begins = _groups(part)
    ends = np.append(begins, len(part))[1:]
    payload = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
    return pa.record_batch([pa.array(part[begins].astype(np.int32)), pa.array(payload, pa.binary())], ["part", "payload"])


def _unpacked(table: pa.Table, kinds: str) -> list[np.ndarray]:
    width = sum(np.dtype(k).itemsize for k in kinds.split())
    out: list[list[np.ndarray]] = [[] for _ in kinds.split()]
    for payload in table.column("payload").to_pylist():
        at, n = 0, len(payload) // width
        for column, kind in zip(out, kinds.split(), strict=True):
            column.append(np.frombuffer(payload, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(column) if column else np.zeros(0, kind) for column, kind in zip(out, kinds.split(), strict=True)]


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal keys begin, in ordered entries."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _spread(values: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(values, np.diff(np.append(begins, n)))


def _reply(shard: np.ndarray, kind: np.ndarray | int, value: np.ndarray, first: np.ndarray) -> pa.Table:
    kind = np.broadcast_to(np.asarray(kind, np.int32), shard.shape)
    return pa.table({"shard": shard.astype(np.int32), "kind": kind, "value": value.view(np.int64), "first": first})


def first_digits(texts: DataFrame, n_parts: int, window: int, gram: int) -> DataFrame:
    """Packed entries (gram, block, document, shard), each block once per batch and shard, dealt by gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SHARD_BYTES):
            found, owner = _blocks(Texts(batch.column(2)), window, gram)
            ids, valid = _ids(batch.column(1))
            at = np.flatnonzero(valid[owner]) if len(owner) else owner
            part = (found.gram[at] % np.uint64(n_parts)).astype(np.int64)
            shard, doc = batch.column(0).to_numpy()[owner[at]], ids[owner[at]]
            order = np.lexsort((doc, found.value[at], shard, part))
            at, part, shard, doc = at[order], part[order], shard[order], doc[order]
            new = _groups(found.value[at], shard)
            yield _packed(part[new], [found.gram[at[new]], found.value[at[new]], doc[new], shard[new].astype(np.int32)])

    return texts.select("shard", "doc", "text").mapInArrow(run, "part int, payload binary")


def order_blocks(table: pa.Table, hot: int = HOT) -> pa.Table:
    """The cut in one partition: replies about settled blocks, and about blocks whose suffixes are to be ordered."""
    gram, block, doc, shard = _unpacked(table, "u8 u8 i8 i4")
    order = np.argsort(gram, kind="stable")
    gram, doc = gram[order], doc[order]
    begins = _groups(gram)
    low, high = np.minimum.reduceat(doc, begins), np.maximum.reduceat(doc, begins)
    order = order[_spread(low != high, begins, len(gram))]  # several documents
    gram, block, doc, shard = _unpacked(table, "u8 u8 i8 i4")
    gram, block, doc, shard = gram[order], block[order], doc[order], shard[order]
    order = np.lexsort((shard, doc, block, gram))
    gram, block, doc, shard = gram[order], block[order], doc[order], shard[order]
    begins = _groups(gram, block)
    first = _spread(doc[begins], begins, len(doc))
    late = doc > first
    variants = _groups(gram[begins])
    n_variants = _spread(np.diff(np.append(variants, len(begins))), variants, len(begins))
    probed = begins[n_variants > 1]
    at = np.append(np.flatnonzero(late), probed)
    kind = np.append(np.full(int(late.sum()), SETTLED), np.where(n_variants[n_variants > 1] > hot, SPLIT, PROBED))
    return _reply(shard[at], kind, block[at], first[at])


def send_blocks(docs: pa.Table, replies: pa.Table, n_parts: int, window: int, gram: int) -> pa.Table:
    """The bytes of the blocks of one shard whose suffixes are to be ordered, dealt by gram or, one window each, by window."""
    if not len(replies) or not len(docs):
        return pa.table([[]] * 5, pa.schema([("part", pa.int32()), ("shard", pa.int32()), *((n, pa.binary()) for n in ("sizes", "docs", "data"))]))
    texts = Texts(docs.column("text").combine_chunks())
    found, owner = _blocks(texts, window, gram)
    ids, valid = _ids(docs.column("doc").combine_chunks())
    wanted = replies.column("value").to_numpy().view(np.uint64)
    order = np.argsort(wanted, kind="stable")
    wanted, first = wanted[order], replies.column("first").to_numpy()[order]
    split = replies.column("kind").to_numpy()[order] == SPLIT
    rank = np.minimum(np.searchsorted(wanted, found.value), len(wanted) - 1)
    at = np.flatnonzero((wanted[rank] == found.value) & (ids[owner] == first[rank]) & valid[owner])
    at = at[np.unique(found.value[at], return_index=True)[1]]
    alone = split[rank[at]]
    some, apart = at[~alone], at[alone]
    single = ranges(found.first[apart], found.last[apart] + 1)
    start, size = np.append(found.first[some], single), np.append(found.last[some] - found.first[some] + window, np.full(len(single), window))
    doc = ids[np.append(owner[some], np.repeat(owner[apart], found.last[apart] - found.first[apart] + 1))]
    part = np.append(found.gram[some], found.hashes.of(single, single + window)) % np.uint64(n_parts)
    order = np.argsort(part, kind="stable")
    part, start, size, doc = part[order].astype(np.int32), start[order], size[order], doc[order]
    data, ends = texts.bytes[ranges(start, start + size)], np.cumsum(size)
    begins = _groups(part)
    bounds = list(zip(begins.tolist(), np.append(begins, len(part))[1:].tolist(), strict=True))
    columns = [
        pa.array(part[begins]),
        pa.array(np.full(len(begins), replies.column("shard")[0].as_py(), np.int32)),
        pa.array([size[a:b].astype("<u4").tobytes() for a, b in bounds], pa.binary()),
        pa.array([doc[a:b].tobytes() for a, b in bounds], pa.binary()),
        pa.array([data[ends[a] - size[a] : ends[b - 1]].tobytes() for a, b in bounds], pa.binary()),
    ]
    return pa.table(columns, ["part", "shard", "sizes", "docs", "data"])


def order_suffixes(data: np.ndarray, at: np.ndarray, doc: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, group of each): those whose first ``depth`` bytes another document has too, ordered by these bytes.

    Suffix i starts at data[at[i]], in document doc[i], and has at least ``depth`` bytes.
    """
    padded = np.append(data, np.zeros(DIGIT, np.uint8))
    digits = np.ndarray(len(data) + 1, ">u8", padded, strides=(1,))  # the eight bytes from every place
    rows, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    for done in range(0, depth, DIGIT):
        digit = digits[at[rows] + done].astype(np.uint64) >> np.uint64(8 * max(0, DIGIT - (depth - done)))
        order = np.lexsort((digit, group)) if done else np.argsort(digit, kind="stable")
        rows, group, digit = rows[order], group[order], digit[order]
        begins = _groups(group, digit)
        if not len(begins):
            break
        low, high = np.minimum.reduceat(doc[rows], begins), np.maximum.reduceat(doc[rows], begins)
        size = np.diff(np.append(begins, len(rows)))
        several = low != high
        rows, group = rows[np.repeat(several, size)], np.repeat(np.arange(int(several.sum())), size[several])
    return rows, group


def order_windows(table: pa.Table, window: int) -> pa.Table:
    """The order in one partition: replies about windows that also start in an earlier document."""
    column = {n: table.column(n).to_pylist() for n in ("sizes", "docs", "data")}
    size = np.frombuffer(b"".join(column["sizes"]), "<u4").astype(np.int64)
    doc, data = np.frombuffer(b"".join(column["docs"]), np.int64), np.frombuffer(b"".join(column["data"]), np.uint8)
    shard = np.repeat(table.column("shard").to_numpy(), [len(x) // 4 for x in column["sizes"]])
    begin, count = np.cumsum(size) - size, size - window + 1
    at, owner = ranges(begin, begin + count), np.repeat(np.arange(len(size)), count)
    rows, group = order_suffixes(data, at, doc[owner], window)
    begins = _groups(group)
    least = np.minimum.reduceat(doc[owner[rows]], begins) if len(begins) else np.zeros(0, np.int64)
    first = _spread(least, begins, len(rows))
    late = doc[owner[rows]] > first
    rows, first = rows[late], first[late]
    value = RangeHash(_TOKENS[data]).of(at[rows], at[rows] + window)
    return _reply(shard[owner[rows]], SINGLE, value, first)


def _firsts(value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and the least document of each."""
    order = np.lexsort((doc, value))
    value, doc = value[order], doc[order]
    begins = _groups(value)
    return value[begins], doc[begins]


def cut_shard(texts: Texts, ids: np.ndarray, valid: np.ndarray, replies: pa.Table, window: int, gram: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(bytes kept of each text, its bytes removed, its removed runs)."""
    found, owner = _blocks(texts, window, gram)
    kind, value = replies.column("kind").to_numpy(), replies.column("value").to_numpy().view(np.uint64)
    first = replies.column("first").to_numpy()
    known = np.flatnonzero(valid[owner]) if len(owner) else owner
    settled = kind == SETTLED
    blocks_seen, least = _firsts(np.append(found.value[known], value[settled]), np.append(ids[owner[known]], first[settled]))
    drop = known[least[np.searchsorted(blocks_seen, found.value[known])] < ids[owner[known]]]
    start, stop = found.first[drop], found.last[drop] + window
    single, earliest = _firsts(value[kind == SINGLE], first[kind == SINGLE])
    if len(single) and len(texts.bytes) >= window:
        runs = found.hashes.runs(window)
        table = np.zeros(1 << 22, bool)
        table[single >> np.uint64(42)] = True
        at = np.flatnonzero(table[runs >> np.uint64(42)])
        rank = np.minimum(np.searchsorted(single, runs[at]), len(single) - 1)
        hit = (single[rank] == runs[at]) & inside(texts.offsets, len(texts.bytes), window)[at]
        at, rank = at[hit], rank[hit]
        text = np.searchsorted(texts.offsets, at, side="right") - 1
        at = at[valid[text] & (earliest[rank] < ids[text])]
        start, stop = np.append(start, at), np.append(stop, at + window)
    gone = covered(len(texts.bytes), start, stop)
    total = np.append(0, np.cumsum(gone))
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    inner = texts.offsets[:-1][np.diff(texts.offsets) > 0]
    opens[inner] = gone[inner]
    spans = np.append(0, np.cumsum(opens))
    a, b = texts.offsets[:-1], texts.offsets[1:]
    kept = [texts.bytes[x:y][~gone[x:y]].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    return kept, total[b] - total[a], spans[b] - spans[a]


def drop_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    shard_bytes: int = SHARD_BYTES,
    hot: int = HOT,
    key: str = "doc_id",
    text: str = "text",
    prefix: str = "",
) -> DataFrame:
    """All rows and columns of docs, with kept (binary), n_bytes, n_removed and n_spans (named after ``prefix``)."""
    spark = docs.sparkSession
    space = Workspace(spark, "suffixes")
    added = [f"{prefix}{n}" for n in ("kept", "n_bytes", "n_removed", "n_spans")]
    docs = docs.drop(*added)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n_shards = int(size // shard_bytes) + 1
    n_parts = n_shards // SHARDS_PER_PART + 1
    shard = F.pmod(F.xxhash64(key, text), F.lit(n_shards)).cast("int")
    texts = docs.select(shard.alias("shard"), F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = docs.select(shard.alias("shard"), F.struct(*docs.columns).alias("row"))

    entries = first_digits(texts, n_parts, window, gram)
    def cut_blocks(table: pa.Table) -> pa.Table:
        return order_blocks(table, hot)

    replies, _ = space.save(entries.groupBy("part").applyInArrow(cut_blocks, _REPLY), "blocks")

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        return send_blocks(left, right, n_parts, window, gram)

    def order(table: pa.Table) -> pa.Table:
        return order_windows(table, window)

    left = replies.where(F.col("kind").isin(PROBED, SPLIT))
    sent = texts.groupBy("shard").cogroup(left.groupBy("shard")).applyInArrow(send, _BLOCKS)
    singles, _ = space.save(sent.groupBy("part").applyInArrow(order, _REPLY), "windows")

    names = docs.columns
    at, by = names.index(text), names.index(key)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = left.column("row").combine_chunks().flatten()
        part = Texts(columns[at])
        ids, valid = _ids(columns[by].cast(pa.int64()))
        kept, n_removed, n_spans = cut_shard(part, ids, valid, right, window, gram)
        made = [pa.array(kept, pa.binary()), *(pa.array(x.astype(np.int64)) for x in (np.diff(part.offsets), n_removed, n_spans))]
        return pa.Table.from_arrays([*columns, *made], names=[*names, *added])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    fields += [f"`{n}` {t}" for n, t in zip(added, ("binary", "bigint", "bigint", "bigint"), strict=True)]
    known = replies.where(F.col("kind") == SETTLED).unionByName(singles)
    return dealt.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(cut, ", ".join(fields))
