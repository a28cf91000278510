"""Substring dedup: word windows that recur anywhere are located by automata and cut out.

1. Every block of windows (see ``anchors``) is counted over the corpus. A block seen twice is a recurring
   passage, all its windows are. A block seen once may still share windows with others
   that have its gram; such blocks hand out their windows one by one.
2. These windows are counted; those seen twice are recurring passages too.
3. Documents are dealt to shards of bounded size, and what is confirmed goes to the shards it occurs in. A shard takes its
   documents slice by slice: each slice compiles one Aho-Corasick automaton over sequences of words, one for each different
   run of confirmed passages in it, and streams its documents through. What a match covers is cut out.

Shards grow in number with the corpus and not in size, and each gets only the passages that occur in it, so work
and memory follow the text; an automaton and the arrays over words and bytes are those of one slice (of its longest
text, if that is longer). Counts are summed per task before they are shuffled.

Defined results: a null or empty text has no words; fewer words than a window stay as they are;
null ids, repeated rows and ids are rows like any other, and count as occurrences of their own; all columns are kept; added columns
replace ones of the same name; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.llm.anchors import Blocks, blocks, covered, inside, ranges
from tierwalk.llm.batches import Texts, Words, pieces
from tierwalk.workspace import Workspace

#: Words of a window, words of a gram, bytes of text in a shard, and those that a shard works on at a time.
WINDOW, GRAM, SHARD_BYTES, SLICE_BYTES = 35, 8, 8 << 20, 1 << 20

SETTLED, PROBED, SINGLE = 1, 2, 3


def _blocks(texts: Texts, window: int, gram: int) -> tuple[Words, Blocks]:
    words = Words(texts)
    return words, blocks(words.hashed(), words.first, window, gram)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def count_blocks(dealt: DataFrame, window: int, gram: int) -> DataFrame:
    """(gram, block, shard, n) of rows (shard, text), summed per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words, found = _blocks(Texts(batch.column(1)), window, gram)
            owner = np.searchsorted(words.first, found.first, side="right") - 1
            shard = batch.column(0).to_numpy()[owner]
            order = np.lexsort((shard, found.value))
            value, shard, grams = found.value[order], shard[order], found.gram[order]
            new = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (shard[1:] != shard[:-1]))) if len(value) else order
            n = np.diff(np.append(new, len(value)))
            yield pa.record_batch(
                [_signed(grams[new]), _signed(value[new]), pa.array(shard[new]), pa.array(n.astype(np.int64))],
                ["gram", "block", "shard", "n"],
            )

    return dealt.select("shard", "text").mapInArrow(run, "gram bigint, block bigint, shard int, n bigint")


def _sorted(table: pa.Table, kind: int) -> np.ndarray:
    keep = table.column("kind").to_numpy() == kind
    return np.unique(table.column("value").to_numpy()[keep].view(np.uint64))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def probe_windows(docs: pa.Table, marks: pa.Table, window: int, gram: int) -> pa.Table:
    """(value, shard, n): the windows of the blocks that are to be probed, each block once."""
    wanted = _sorted(marks, PROBED)
    done, values = np.zeros(len(wanted), bool), [np.zeros(0, np.uint64)]
    for batch in pieces(docs.select(["text"]).to_batches(), "text", SLICE_BYTES):
        _, found = _blocks(Texts(batch.column(0)), window, gram)
        probed = np.flatnonzero(_among(found.value, wanted))
        probed = probed[np.unique(found.value[probed], return_index=True)[1]]
        place = np.searchsorted(wanted, found.value[probed])
        probed = probed[~done[place]]
        done[place] = True
        start = ranges(found.first[probed], found.last[probed] + 1)
        values.append(found.hashes.of(start, start + window))
    value, n = np.unique(np.concatenate(values), return_counts=True)
    shard = marks.column("shard")[0].as_py() if len(marks) else 0
    return pa.table({"value": _signed(value), "shard": pa.array(np.full(len(value), shard, np.int32)), "n": n.astype(np.int64)})


def passages(marked: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of the longest marked runs inside single texts."""
    opens, shuts = np.zeros(len(marked) + 1, bool), np.zeros(len(marked) + 1, bool)
    opens[:-1], shuts[1:] = marked, marked
    inner = first[(first > 0) & (first < len(marked))]
    opens[1:-1] &= ~marked[:-1]
    opens[inner] = marked[inner]
    shuts[1:-1] &= ~marked[1:]
    shuts[inner] = marked[inner - 1]
    return np.flatnonzero(opens), np.flatnonzero(shuts)


def cut_slice(texts: Texts, known: np.ndarray, single: np.ndarray, window: int, gram: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(what is kept of each text, its words, its words removed), given the settled blocks and single windows of the shard."""
    words = Words(texts)
    codes, _ = words.coded()
    n_words = np.diff(words.first)
    found = blocks(words.hashed(), words.first, window, gram)
    settled = np.flatnonzero(_among(found.value, known))
    start, stop = found.first[settled], found.last[settled] + window
    if len(single):
        at = np.flatnonzero(_among(found.hashes.runs(window), single) & inside(words.first, len(words), window))
        start, stop = np.append(start, at), np.append(stop, at + window)
    start, stop = passages(covered(len(words), start, stop), words.first)
    some = np.unique(found.hashes.of(start, stop), return_index=True)[1]
    start, stop = start[some], stop[some]
    gone = np.zeros(len(words), bool)
    if len(start):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        listed = codes.tolist()
        for a, b in zip(start.tolist(), stop.tolist(), strict=True):
            automaton.add_word(tuple(listed[a:b]))
        automaton.make_automaton()
        lasts, sizes = [], []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= window:
                for last, size in automaton.iter(tuple(listed[a:b])):
                    lasts.append(a + last + 1)
                    sizes.append(size)
        stops = np.array(lasts, np.int64)
        gone = covered(len(words), stops - np.array(sizes, np.int64), stops)
    total = np.append(0, np.cumsum(gone))
    n_removed = total[words.first[1:]] - total[words.first[:-1]]
    # A removed word goes with the white space after it.
    reach = np.append(words.start[1:], len(texts.bytes)) if len(words) else words.start
    last = words.first[1:][n_words > 0] - 1
    reach[last] = texts.offsets[1:][n_words > 0]
    keep = ~covered(len(texts.bytes), words.start[gone], reach[gone])
    data, kept = texts.bytes, []
    for i, (a, b) in enumerate(zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True)):
        if n_removed[i] == n_words[i] and n_words[i]:
            kept.append(b"")
        else:
            kept.append((data[a:b][keep[a:b]] if n_removed[i] else data[a:b]).tobytes())
    return kept, n_words, n_removed


def cut_shard(docs: pa.RecordBatch, marks: pa.Table, window: int, gram: int, text: str, added: list[str]) -> pa.Table:
    """docs, with what is kept of each text, its words and its words removed as columns ``added``."""
    known, single = _sorted(marks, SETTLED), _sorted(marks, SINGLE)
    fields = [pa.field(name, kind) for name, kind in zip(added, (pa.string(), pa.int64(), pa.int64()), strict=True)]
    schema = pa.schema([*docs.schema, *fields])
    done = []
    for batch in pieces([docs], text, SLICE_BYTES):
        kept, n_words, n_removed = cut_slice(Texts(batch.column(text)), known, single, window, gram)
        out = pa.array([k.decode() for k in kept], pa.string())
        counts = [pa.array(n.astype(np.int64)) for n in (n_words, n_removed)]
        done.append(pa.RecordBatch.from_arrays([*batch.columns, out, *counts], schema=schema))
    return pa.Table.from_batches(done, schema)


def cut_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    shard_bytes: int = SHARD_BYTES,
    key: str = "doc_id",
    text: str = "text",
    prefix: str = "",
) -> DataFrame:
    """All rows and columns of docs, with kept_text, n_words and n_removed (named after ``prefix``)."""
    spark = docs.sparkSession
    space = Workspace(spark, "phrases")
    added = [f"{prefix}{n}" for n in ("kept_text", "n_words", "n_removed")]
    docs = docs.drop(*added)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n_shards = int(size // shard_bytes) + 1
    shard = F.pmod(F.xxhash64(key, text), F.lit(n_shards)).cast("int")
    dealt = docs.select(shard.alias("shard"), F.struct(*docs.columns).alias("row"))
    texts = docs.select(shard.alias("shard"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    counted, _ = space.save(count_blocks(texts, window, gram), "blocks")
    by_gram = counted.repartition("gram")
    variants = by_gram.groupBy("gram", "block").agg(F.sum("n").alias("n"), F.min("shard").alias("first"))
    grams = variants.groupBy("gram").agg(
        F.count(F.lit(1)).alias("variants"), F.count(F.when(F.col("n") == 1, 1)).alias("lone"), F.sum("n").alias("total")
    )
    judged = variants.join(grams.where("total > 1"), "gram").select(
        "gram", "block", "first", (F.col("n") > 1).alias("settled"), ((F.col("variants") > 1) & (F.col("lone") > 0)).alias("probed")
    )
    marks = by_gram.select("gram", "block", "shard").distinct().join(judged.where("settled OR probed"), ["gram", "block"])
    kinds = F.array(
        F.when(F.col("settled"), SETTLED), F.when(F.col("probed") & (F.col("shard") == F.col("first")), PROBED)
    )
    marks = marks.select("shard", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"), F.col("block").alias("value"))
    marks, _ = space.save(marks, "marks")

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        return probe_windows(left, right, window, gram)

    probes = texts.groupBy("shard").cogroup(marks.where(F.col("kind") == PROBED).groupBy("shard")).applyInArrow(
        probe, "value bigint, shard int, n bigint"
    )
    probes, _ = space.save(probes, "probes")
    twice = probes.groupBy("value").agg(F.sum("n").alias("total")).where("total > 1").select("value")
    singles = probes.join(twice, "value").select("shard", F.lit(SINGLE).alias("kind"), "value")

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = pa.RecordBatch.from_struct_array(left.column("row").combine_chunks())
        return cut_shard(rows, right, window, gram, text, added)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    fields += [f"`{added[0]}` string", f"`{added[1]}` bigint", f"`{added[2]}` bigint"]
    known = marks.where(F.col("kind") == SETTLED).select("shard", "kind", "value").unionByName(singles)
    return dealt.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(cut, ", ".join(fields))
