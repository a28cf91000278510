"""Source divergence audit: how far the term shares of each source are from those of the other sources of its language.

A *part* (a language) has *groups* (its sources) and *terms*; a term is kept if enough rows of the part
hold it. With c the count of a term in a group, N the group's count of all kept terms and V their number, the term's share is
p = 1 + floor(10**9 * (c + 2) / (N + 2 V)), and two shares are (p - q)**2 // (p + q) apart. All of it is integers.

The count matrix of a part (groups down, terms across) is cut by terms into shards of bounded size. Each shard is a k-squared
quadtree: quadrants without a count are absent, leaves of ``LEAF`` x ``LEAF`` cells hold the counts. A pair of bands of groups goes
down both their paths of the tree at once, level by level: where both quadrants are absent, the cells are alike for a pair of
groups, so its distance times the width is the price; the rest ends in leaves, where cells are compared. Groups are
ordered by size and terms by how many groups hold them, which keeps the zeros together. Nothing larger than a shard's counts and one
pair of bands is held at a time; sums per pair are added up by Spark.

Terms are runs of letters A-Z, a-z and of all characters beyond ASCII; only A-Z are lower-cased. They are counted per
batch of texts first, then per group, so that a part, group or term of any share of the rows is added up before it is shuffled.

Defined results: null texts, parts and groups are empty strings; a group without terms is there with all counts zero; without kept terms
all distances are 0; repeated rows count each; ties go by name, bytes ascending; texts are read whole; other columns are ignored; an empty table gives no rows.
Counts up to 9 * 10**15 per part are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierwalk.llm.batches import Texts, Words, pieces
from tierwalk.workspace import Workspace

#: Bytes that are in no term.
GAP = np.ones(256, bool)
GAP[65:91] = GAP[97:123] = GAP[128:] = False

SCALE = 1_000_000_000
#: Rows that hold a kept term, at least; rows of the ``term`` part per group.
LEAST, BEST = 10, 10
#: Counts in a shard: as many as it gives sums per pair, within these bounds. Cells a side of a leaf, leaves compared at a time.
SHARD, LARGEST, LEAF, WIDE = 100_000, 2_000_000, 32, 8

COUNTS = "part string, grp string, term string, n bigint, n_rows bigint"


def batch_counts(part: pa.Array, group: pa.Array, column: pa.Array) -> pa.RecordBatch:
    """(part, group, term, count, rows) of a batch, and a row without a term for each group."""
    parts, groups = (pc.fill_null(c, "").dictionary_encode() for c in (part, group))
    n_groups = max(len(groups.dictionary), 1)
    owner = parts.indices.to_numpy().astype(np.int64) * n_groups + groups.indices.to_numpy()
    words = Words(Texts(column).lower(), GAP)
    codes, distinct = words.coded()
    n_terms = max(len(distinct), 1)
    row = np.repeat(np.arange(len(column)), np.diff(words.first))
    held, times = np.unique(row * n_terms + codes, return_counts=True)
    row, code = np.divmod(held, n_terms)
    key = owner[row] * n_terms + code
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    n = np.add.reduceat(times, first) if len(first) else np.zeros(0, np.int64)
    n_rows = np.diff(np.append(first, len(key)))
    both, code = np.divmod(key[first], n_terms)
    alone = np.unique(owner)
    both, none = np.append(both, alone), np.zeros(len(alone), np.int64)
    terms = pa.concat_arrays([distinct.take(pa.array(code)).cast(pa.string()), pa.nulls(len(alone), pa.string())])
    return pa.record_batch(
        [
            parts.dictionary.take(pa.array(both // n_groups)),
            groups.dictionary.take(pa.array(both % n_groups)),
            terms,
            pa.array(np.append(n, none)),
            pa.array(np.append(n_rows, none)),
        ],
        names=["part", "grp", "term", "n", "n_rows"],
    )


def count_terms(docs: DataFrame, part: str, group: str, text: str) -> DataFrame:
    """(part, grp, term, n, n_rows): how often a group has a term and in how many rows; a null term for every group."""
    texts = docs.select(F.col(part).alias("part"), F.col(group).alias("grp"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield batch_counts(*batch.columns)

    counted = texts.mapInArrow(run, COUNTS)
    return counted.groupBy("part", "grp", "term").agg(F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows"))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / total), three digits at a time so that no product overflows."""
    out, rest = np.divmod(count + 2, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Quadtree:
    """Counts of a matrix by quadrant. ``levels[l]`` are the codes of the quadrants with counts, of 4**l."""

    def __init__(self, row: np.ndarray, column: np.ndarray, count: np.ndarray, n_rows: int, n_columns: int):
        self.n_rows, self.n_columns = n_rows, n_columns
        side = -(-max(n_rows, n_columns, 1) // LEAF)
        self.height = (side - 1).bit_length()
        code = self.code(row // LEAF, column // LEAF)
        order = np.argsort(code, kind="stable")
        self.row, self.column, self.count = row[order] % LEAF, column[order] % LEAF, count[order]
        leaves, first = np.unique(code[order], return_index=True)
        self.first = np.append(first, len(code))
        self.levels = [leaves]
        for _ in range(self.height):
            self.levels.append(np.unique(self.levels[-1] >> 2))
        self.levels.reverse()

    @staticmethod
    def code(row: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The two numbers with their bits interleaved."""
        out = np.zeros(np.broadcast(row, column).shape, np.int64)
        for bit in range(28):
            out |= ((row >> bit & 1) << (2 * bit + 1)) | ((column >> bit & 1) << (2 * bit))
        return out

    def held(self, level: int, row: int, columns: np.ndarray) -> np.ndarray:
        """Which quadrants of a row of quadrants have counts."""
        codes, known = self.code(np.int64(row), columns), self.levels[level]
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1) if len(known) else 0
        return known[at] == codes if len(known) else np.zeros(len(columns), bool)

    def joint(self, a: int, b: int) -> tuple[int, np.ndarray]:
        """(columns where bands a and b of rows have no counts, columns of leaves where one of them has)."""
        columns, absent = np.zeros(1, np.int64), 0
        for level in range(self.height + 1):
            up = self.height - level
            some = self.held(level, a >> up, columns) | self.held(level, b >> up, columns)
            width = LEAF << up
            begin = columns[~some] * width
            absent += int(np.clip(np.minimum(begin + width, self.n_columns) - begin, 0, None).sum())
            columns = columns[some]
            if up:
                columns = np.stack([2 * columns, 2 * columns + 1], axis=1).ravel()
        return absent, columns

    def leaves(self, band: int, columns: np.ndarray) -> np.ndarray:
        """Counts of a band of rows in some columns of leaves, side by side."""
        out = np.zeros((LEAF, len(columns) * LEAF), np.int64)
        known = self.levels[-1]
        for k, code in enumerate(self.code(np.int64(band), columns).tolist()):
            at = int(np.searchsorted(known, code))
            if at < len(known) and known[at] == code:
                inside = slice(self.first[at], self.first[at + 1])
                out[self.row[inside], k * LEAF + self.column[inside]] = self.count[inside]
        return out

    def distances(self, a: int, b: int, total: np.ndarray) -> np.ndarray:
        """Sum over all columns, for each row of band a and each of band b; total: N + 2 V by row."""
        size_a, size_b = (min(LEAF, self.n_rows - x * LEAF) for x in (a, b))
        total_a, total_b = total[a * LEAF :][:size_a, None], total[b * LEAF :][:size_b, None]
        absent, columns = self.joint(a, b)
        zero = np.zeros((1, 1), np.int64)
        out = absent * apart(share(zero, total_a), share(zero, total_b).T)
        for k in range(0, len(columns), WIDE):
            some = columns[k : k + WIDE]
            real = (some[:, None] * LEAF + np.arange(LEAF)).ravel() < self.n_columns
            p = share(self.leaves(a, some)[:size_a, real], total_a)
            q = share(self.leaves(b, some)[:size_b, real], total_b)
            out += apart(p[:, None, :], q[None, :, :]).sum(axis=2)
        return out


def _first_of(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def audit_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per pair of groups over the terms of a shard, and the best terms of each group in it.

    Rows with a null term are the groups: their N + 2 V as n, and that of the part as total.
    """
    table = pa.Table.from_batches(list(batches)).combine_chunks()
    if not table.num_rows:
        return
    is_group = pc.is_null(table.column("term"))
    groups, posts = table.filter(is_group), table.filter(pc.invert(is_group))
    groups = groups.sort_by([("n", "descending"), ("grp", "ascending")])
    names = groups.column("grp").combine_chunks()
    total, part_total = _first_of(groups, "n"), int(_first_of(groups, "total")[0])
    part = groups.column("part")[0]
    row = pc.index_in(posts.column("grp"), value_set=names).combine_chunks().to_numpy().astype(np.int64)
    terms = posts.column("term").combine_chunks().dictionary_encode()
    terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
    term, words = terms.indices.to_numpy().astype(np.int64), terms.dictionary
    count = _first_of(posts, "n")
    holders = np.bincount(term, minlength=len(words))
    place = np.empty(len(words), np.int64)
    place[np.argsort(-holders, kind="stable")] = np.arange(len(words))
    tree = Quadtree(row, place[term], count, len(names), len(words))

    def rows(kind: str, source: np.ndarray, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
        n = len(source)
        return pa.record_batch(
            [pa.array([part.as_py()] * n, pa.string()), names.take(pa.array(source)), pa.array([kind] * n, pa.string()), item, pa.array(value)],
            names=["part", "grp", "kind", "item", "value"],
        )

    bands = -(-len(names) // LEAF)
    for a in range(bands):
        for b in range(a, bands):
            value = tree.distances(a, b, total)
            i, j = np.nonzero(np.ones_like(value, bool) if a != b else np.triu(np.ones_like(value, bool), 1))
            if len(i):
                yield rows("pair", a * LEAF + i, names.take(pa.array(b * LEAF + j)), value[i, j])

    p, q = share(count, total[row]), share(_first_of(posts, "total"), np.int64(part_total))
    more = np.flatnonzero(p > q)
    if len(more):
        value = apart(p[more], q[more])
        name = np.empty(len(words), np.int64)
        name[pc.array_sort_indices(words).to_numpy()] = np.arange(len(words))
        order = np.lexsort((name[term[more]], -value, row[more]))
        more, value = more[order], value[order]
        start = np.searchsorted(row[more], np.arange(len(names)))
        best = np.arange(len(more)) - start[row[more]] < BEST
        more, value = more[best], value[best]
        yield rows("term", row[more], words.take(pa.array(term[more])), value)


def audit(docs: DataFrame, part: str = "lang", group: str = "source", text: str = "text", least: int = LEAST) -> DataFrame:
    """(part, grp, kind, item, value, rank): kind ``pair`` has every other group of the part, farthest first; kind
    ``term`` the ten terms by which a group is furthest above its part."""
    ws = Workspace(docs.sparkSession, "divergence")
    counts, _ = ws.save(count_terms(docs, part, group, text), "counts")
    named = counts.where(F.col("term").isNotNull())
    kept = named.groupBy("part", "term").agg(F.sum("n_rows").alias("n_rows"), F.sum("n").alias("total"))
    kept, _ = ws.save(kept.where(F.col("n_rows") >= least).drop("n_rows"), "kept")
    posts, n_posts = ws.save(named.drop("n_rows").join(kept, ["part", "term"]), "posts")
    in_part = counts.where(F.col("term").isNull()).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    n_pairs = in_part.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0))).first()[0]
    shards = max(1, -(-n_posts // min(max(SHARD, n_pairs), LARGEST)))

    sizes = kept.groupBy("part").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("total"))
    sums = posts.groupBy("part", "grp").agg(F.sum("n").alias("n"))
    groups = counts.where(F.col("term").isNull()).select("part", "grp").join(sums, ["part", "grp"], "left").join(sizes, "part", "left")
    double = 2 * F.coalesce("v", F.lit(0))
    # Without kept terms there is nothing to divide; any total does.
    groups = groups.select(
        "part", "grp", F.lit(None).cast("string").alias("term"),
        F.greatest(F.coalesce("n", F.lit(0)) + double, F.lit(1)).alias("n"),
        F.greatest(F.coalesce("total", F.lit(0)) + double, F.lit(1)).alias("total"),
    )
    everywhere = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    dealt = posts.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int")).unionByName(everywhere)
    found = dealt.groupBy("part", "shard").applyInArrow(audit_shard, "part string, grp string, kind string, item string, value bigint")
    found, _ = ws.save(found, "found")

    half = found.where(F.col("kind") == "pair").groupBy("part", "grp", "kind", "item").agg(F.sum("value").alias("value"))
    ends = F.array(F.struct("grp", "item"), F.struct(F.col("item").alias("grp"), F.col("grp").alias("item")))
    pairs = half.select("part", "kind", "value", F.explode(ends).alias("end")).select("part", "end.grp", "kind", "end.item", "value")
    terms = found.where(F.col("kind") == "term")
    place = F.row_number().over(Window.partitionBy("part", "grp", "kind").orderBy(F.desc("value"), "item"))
    ranked = terms.withColumn("rank", place).where(F.col("rank") <= BEST)
    return pairs.withColumn("rank", place).unionByName(ranked.select("part", "grp", "kind", "item", "value", "rank"))
