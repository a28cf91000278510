"""Paths: of the answers back to their seeds, and between two nodes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.operators.batch import small_table
from tierwalk.operators.graph import BROADCAST_ROWS, Graph
from tierwalk.operators.star import STAR
from tierwalk.operators.visit import Visit, meet_edges
from tierwalk.params import Domain
from tierwalk.workspace import Log, Workspace


def walk_back(visit: Visit, ends: DataFrame) -> DataFrame:
    """Parent chains of visited pairs: ends(walk key, node_id, ...) plus ``path``, listed
    from the seed.

    Going down hop by hop, the pairs on some chain are picked out of the rows of one hop by their keys, which are no more
    than the ends. Paths are put together from these, so no hop of the state is moved.
    """
    keys = list(visit.keys)
    at = [*keys, "node_id"]
    ws = Workspace(ends.sparkSession, "paths")
    ends, n = ws.save(ends, "ends")

    def picked(pairs: DataFrame, few: DataFrame) -> DataFrame:
        few = few.select(*at).distinct()
        return pairs.join(F.broadcast(few) if n <= BROADCAST_ROWS else few, at, "left_semi")

    placed, _ = ws.save(ends.join(picked(visit.state.select(*at, "dist"), ends), at), "placed")
    levels, above = {}, None
    for hop in range(len(visit.hops) - 1, 0, -1):
        heads = placed.where(F.col("dist") == hop).select(*at)
        heads = heads if above is None else heads.unionByName(above)
        rows = visit.state.where(F.col("dist") == hop).select(*at, "parent_id")
        levels[hop], _ = ws.save(picked(rows, heads), f"level-{hop}")
        above = levels[hop].select(*keys, F.col("parent_id").alias("node_id"))
    paths = placed.withColumn("path", F.array("node_id"))
    for hop, level in levels.items():
        on_hop = F.col("dist") - F.size("path") + 1 == hop
        longer = F.array_prepend("path", F.col("parent_id"))
        paths = (
            paths.withColumn("head", F.when(on_hop, F.col("path")[0]))
            .join(level.withColumnRenamed("node_id", "head"), [*keys, "head"], "left")
            .withColumn("path", F.when(F.col("parent_id").isNull(), F.col("path")).otherwise(longer))
            .drop("head", "parent_id")
        )
    return paths.drop("dist")


def answer_paths(visit: Visit, answers: DataFrame) -> DataFrame:
    """One shortest path per (answer, seed), by smallest parent id."""
    wanted = answers.select(*STAR, "node_id").join(visit.uses, STAR)
    ends = wanted.select(*dict.fromkeys([*visit.keys, *STAR, "seed_id"]), "node_id")
    return walk_back(visit, ends).select(*STAR, "node_id", "seed_id", "path")


def shortest_path(
    graph: Graph, src: int, dst: int, domain: Domain | None = None, max_hops: int | None = None
) -> DataFrame:
    """One row (src, dst, path): [src] when both are the same, empty when unreachable. Of several shortest
    paths the one whose nodes, from the end, have the smallest ids.

    Two searches, forth from src and back from dst; the smaller frontier grows until a level of one meets the last level of
    the other. From where they meet, only nodes on shortest paths are followed on to dst. A step back has no buckets
    to select: it reads the two ids of every edge, and the frontier goes to the edges.
    """
    spark = graph.spark
    pair = small_table(spark, {"src": pa.int64(), "dst": pa.int64()}, [(src, dst)])
    if src == dst:
        return pair.withColumn("path", F.array("src"))
    ws = Workspace(spark, "path")
    search = TwoSided(ws, graph, src, dst)
    try:
        found = search.run(max_hops)
        path = search.path() if found else small_table(spark, {"dst": pa.int64()}, []).withColumn("path", F.array("dst"))
        # The rows of the searches are read before their tables go.
        path, _ = ws.save(path, "found")
    finally:
        search.close()
    return pair.join(path, "dst", "left").select("src", "dst", F.coalesce("path", F.array().cast("array<bigint>")).alias("path"))


class TwoSided:
    """Levels of nodes by distance from src (``forth``, with the smallest parent) and to dst (``back``)."""

    def __init__(self, ws: Workspace, graph: Graph, src: int, dst: int):
        self.ws, self.graph, self.dst = ws, graph, dst
        none = F.lit(None).cast("bigint").alias("parent_id")
        starts = [graph.nodes.where(F.col("node_id") == end).select("node_id", none) for end in (src, dst)]
        self.logs = [Log(ws, name, starts[0].schema, ["node_id"]) for name in ("forth", "back")]
        self.rows = [[log.append(start, 0)[0]] for log, start in zip(self.logs, starts)]

    @property
    def visited(self) -> int:
        return sum(map(sum, self.rows))

    def last(self, side: int) -> DataFrame:
        hop = len(self.rows[side]) - 1
        return self.logs[side].upto(hop, hop)

    def _step(self, side: int) -> int:
        """Grow one side by a level; returns how many of its nodes are on the other's last level."""
        hop, rows = len(self.rows[side]), self.rows[side][-1]
        steps = self.last(side).select(F.col("node_id").alias("node"))
        if side == 0:
            met = meet_edges(steps, rows, 1, self.graph).groupBy(F.col("dst").alias("node_id")).agg(F.min("src").alias("parent_id"))
        else:
            steps = F.broadcast(steps) if rows <= BROADCAST_ROWS else steps
            reached = self.graph.edges.select("src", "dst").join(steps, F.col("dst") == F.col("node"), "left_semi")
            met = reached.groupBy(F.col("src").alias("node_id")).agg(F.lit(None).cast("bigint").alias("parent_id"))
        fresh = met.join(self.logs[side].upto(hop - 1).select("node_id"), "node_id", "left_anti")
        marked = fresh.join(self.last(1 - side).select("node_id", F.lit(True).alias("met")), "node_id", "left")
        n, hits = self.logs[side].append(marked, hop, met=F.col("met"))
        self.rows[side].append(n)
        return hits

    def run(self, max_hops: int | None = None) -> bool:
        while all(r[-1] for r in self.rows) and (max_hops is None or sum(map(len, self.rows)) - 2 < max_hops):
            if self._step(0 if self.rows[0][-1] <= self.rows[1][-1] else 1):
                return True
        return False

    def path(self) -> DataFrame:
        """(dst, path) once the searches have met."""
        forth, back = self.logs
        on = self.last(0).select("node_id").join(self.last(1).select("node_id"), "node_id", "left_semi")
        on, n = self.ws.save(on, "met")
        parents = []
        for level in range(len(self.rows[1]) - 2, -1, -1):
            nearer = back.upto(level, level).select(F.col("node_id").alias("dst"))
            ahead = meet_edges(on.select(F.col("node_id").alias("node")), n, 1, self.graph).select("src", "dst")
            ahead = ahead.join(nearer, "dst", "left_semi").groupBy(F.col("dst").alias("node_id")).agg(F.min("src").alias("parent_id"))
            on, n = self.ws.save(ahead, f"on-{level}")
            parents.append(on)
        parents = parents[::-1] + [forth.upto(h, h).select("node_id", "parent_id") for h in range(len(self.rows[0]) - 1, 0, -1)]
        path = small_table(self.graph.spark, {"dst": pa.int64()}, [(self.dst,)]).withColumn("path", F.array("dst"))
        for level in parents:
            # One row goes to the level, not the level to it.
            heads = F.broadcast(path.withColumn("node_id", F.col("path")[0]))
            path = heads.join(level, "node_id").select("dst", F.array_prepend("path", F.col("parent_id")).alias("path"))
        return path

    def close(self) -> None:
        for log in self.logs:
            log.close()
