"""Exact top-k by inner product over integer vectors, with MaxScore.

A query's terms are its non-zero components. A shard of vectors keeps two posting lists a component, built once: the
vectors where it is positive and those where it is negative, with their values. A term's list is the one of the query's own
sign, for only that can add to a score; its bound is the most it can add. Terms are ordered by bound. As long as
the bounds of the last terms together stay below the k-th best score so far, those terms are
non-essential: a vector found in none of the essential lists cannot enter. The essential lists are traversed and what they
add is summed per vector; whoever is found there is probed, while it can still compete, for what the essential terms take away and
for the non-essential terms.

Shards are slices of the vectors' own partitions, so nothing but results is shuffled: k rows
per query and shard, of which a window keeps k. Queries are taken in blocks of a fixed number, one block after another:
a block is broadcast, what it found is written to the shared folder, and the broadcast goes.

Defined results: a vector that is null, or holds a null, NaN or infinite component, takes no part,
neither as a query nor as a candidate; so does a row whose id is null; ids are whole numbers (others raise); components that one of two
vectors lacks add nothing; an empty vector scores 0; rows repeating an id are candidates of
their own, except for a query of the same id; equal scores go by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tierwalk.workspace import Workspace

#: Queries in a block, and vectors in a shard.
BLOCK = 4_096
SHARD = 2_048


def whole_vectors(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(key, vector: array<bigint>) with each component x as floor(scale * x); rows that take no part are left out."""
    real = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(
        real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return (
        rows.select(key, real.alias("vector"))
        .where(F.col(key).isNotNull() & F.col("vector").isNotNull() & finite)
        .select(key, F.transform("vector", lambda x: F.floor(x * scale).cast("long")).alias("vector"))
    )


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class Best:
    """The k best (score, id) so far: higher score first, then smaller id."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]

    def least(self) -> float:
        """What a newcomer has to reach."""
        return self.scores[-1] if len(self.ids) >= self.k else -np.inf


class Shard:
    """Vectors with their posting lists: rows ordered by value within each component, the negative ones first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.columns = ids, np.ascontiguousarray(vectors.T)
        self.high = np.maximum(self.columns.max(axis=1, initial=0), 0)
        self.low = np.minimum(self.columns.min(axis=1, initial=0), 0)
        order = np.argsort(self.columns, axis=1, kind="stable")
        below, above = (self.columns < 0).sum(axis=1), (self.columns > 0).sum(axis=1)
        self.negative = [rows[:n] for rows, n in zip(order, below.tolist(), strict=True)]
        self.positive = [rows[len(rows) - n :] for rows, n in zip(order, above.tolist(), strict=True)]

    def postings(self, term: int, weight: int) -> np.ndarray:
        """The vectors to whose score a query's term can add."""
        return self.positive[term] if weight > 0 else self.negative[term]

    def search(self, query_id: int, query: np.ndarray, best: Best) -> None:
        query = query[: len(self.columns)]
        terms = np.flatnonzero(query)
        bound = np.where(query[terms] > 0, query[terms] * self.high[terms], query[terms] * self.low[terms])
        order = np.argsort(-bound, kind="stable")
        terms, bound = terms[order], bound[order]
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0)  # rest[i]: bounds of term i and all after it
        least = best.least()
        essential = int(np.count_nonzero(rest[:-1] >= least)) if least > -np.inf else len(terms)
        added, listed = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool)
        for t in terms[:essential].tolist():
            rows = self.postings(t, query[t])
            added[rows] += query[t] * self.columns[t, rows]
            listed[rows] = True
        if least <= 0:
            listed[:] = True  # a vector in no list scores 0 at most, which would do
        alive = np.flatnonzero(listed & (added + rest[essential] >= least) & (self.ids != query_id))
        score = added[alive]
        # What essential terms take away, then all of the others; ``left`` is the most that can still be added.
        for i, t in enumerate(terms.tolist()):
            if not len(alive):
                return
            if i % 8 == 0 and least > -np.inf:
                left = rest[max(i, essential)]
                keep = score + left >= least
                alive, score = alive[keep], score[keep]
            part = query[t] * self.columns[t, alive]
            score += np.minimum(part, 0) if i < essential else part
        best.add(self.ids[alive], score)


def top_k(vectors: DataFrame, queries: DataFrame, key: str, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, key, score): the k best vectors for each query, the query's own id left out.

    Both sides come from ``whole_vectors``.
    """
    space = Workspace(vectors.sparkSession, "topk")
    asked, total = space.save(queries.select(F.col(key).cast("long").alias(key), "vector"), "queries")
    blocks = max(1, -(-total // block))
    # One more than needed keeps a block below its size although hashing deals unevenly.
    blocks = blocks if blocks == 1 else blocks + blocks // 4 + 1
    vectors = vectors.select(F.col(key).cast("long").alias(key), "vector")
    for b in range(blocks):
        _search_block(vectors, asked.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b), key, k, space, f"found-{b}")
    found = space.read(_found(key), *(f"found-{b}" for b in range(blocks)))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return (
        found.withColumn("rank", F.row_number().over(by_score))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", key, "score")
    )


def _found(key: str) -> StructType:
    return StructType([StructField(name, LongType()) for name in ("query_id", key, "score")])


def _search_block(vectors: DataFrame, queries: DataFrame, key: str, k: int, space: Workspace, name: str) -> None:
    asked = queries.toArrow().combine_chunks()
    query_ids = asked.column(0).to_numpy()
    rows = asked.column(1).combine_chunks() if asked.num_rows else pa.array([], pa.list_(pa.int64()))
    rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
    shared = vectors.sparkSession.sparkContext.broadcast((query_ids, _matrix(rows)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = shared.value
        best = [Best(k) for _ in ids]
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                part = batch.slice(at, SHARD)
                shard = Shard(part.column(0).to_numpy(), _matrix(part.column(1)))
                for query_id, query, top in zip(ids, asked, best, strict=True):
                    shard.search(query_id, query, top)
        yield pa.record_batch(
            [
                pa.array(np.repeat(ids, [len(b.ids) for b in best]), pa.int64()),
                pa.array(np.concatenate([b.ids for b in best] or [np.zeros(0, np.int64)]), pa.int64()),
                pa.array(np.concatenate([b.scores for b in best] or [np.zeros(0, np.int64)]), pa.int64()),
            ],
            ["query_id", key, "score"],
        )

    space.write(vectors.mapInArrow(search, _found(key)), name)
    shared.unpersist()
