"""Types of which a walk has visited every node.

An edge into such a type leads to a visited pair, so the walk need not send along it: what is left out is what the
anti-join with the visited pairs would take out after the shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.operators.batch import SEED_COLUMNS, small_table
from tierwalk.operators.graph import Graph, type_counts
from tierwalk.workspace import SMALL, Log, Workspace

# Pairs of a walk and a type that are counted at most; the driver sees those that are full.
PAIRS = 10_000


class Filled:
    """Counts the pairs of each (walk, type), fed by the log once it is large; each hop is counted once.

    ``types`` are full for all walks, ``everywhere`` tells that all are.
    """

    def __init__(self, ws: Workspace, graph: Graph, keys, walks: int):
        self.ws, self.graph, self.keys, self.walks = ws, graph, list(keys), walks
        self.sizes: DataFrame | None = None
        self.n_types, self.counted = 0, -1
        self.parts: list[str] = []
        self.types: list[int] = []
        self.everywhere = False

    def after(self, hop: int, log: Log) -> DataFrame | None:
        """(walk key, dst_type) of which every node is visited after a hop, beyond ``types``; none if that is not known."""
        if log.total <= SMALL or self.walks > PAIRS:
            return None
        if self.sizes is None:
            self.sizes, self.n_types = self.ws.save(type_counts(self.graph), "sizes")
        if self.walks * self.n_types > PAIRS:
            return None
        counts = log.upto(hop, self.counted + 1).groupBy(*self.keys, "type_id").agg(F.count(F.lit(1)).alias("n"))
        self.counted = hop
        self.parts.append(f"filled-{hop}")
        self.ws.write(counts, self.parts[-1])
        visited = self.ws.read(counts.schema, *self.parts).groupBy(*self.keys, "type_id").agg(F.sum("n").alias("n"))
        full = visited.join(F.broadcast(self.sizes), "type_id").where(F.col("n") >= F.col("n_nodes"))
        rows = full.select(*self.keys, F.col("type_id").alias("dst_type")).collect()
        walks: dict[int, int] = {}
        for row in rows:
            walks[row["dst_type"]] = walks.get(row["dst_type"], 0) + 1
        self.types = [t for t, n in walks.items() if n == self.walks]
        self.everywhere = len(rows) == self.walks * self.n_types
        some = [tuple(r) for r in rows if r["dst_type"] not in self.types]
        columns = {k: SEED_COLUMNS.get(k, pa.bool_()) for k in self.keys}
        return small_table(self.graph.spark, {**columns, "dst_type": pa.int32()}, some) if some else None
