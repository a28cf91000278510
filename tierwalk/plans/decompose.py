"""Query graph to chain of stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.operators.batch import Batch
from tierwalk.workspace import Workspace


def check_chains(unknowns: DataFrame, unknown_edges: DataFrame) -> None:
    """Raise for a query with a branch, a stray edge, a repeated unknown, or other than one head."""
    ends = unknown_edges.select("query_id", F.explode(F.array("unknown_id", "next_id")).alias("unknown_id"))
    stray = ends.join(unknowns, ["query_id", "unknown_id"], "left_anti").select("query_id")
    branch = [
        unknown_edges.groupBy("query_id", side).count().filter("count > 1").select("query_id")
        for side in ("unknown_id", "next_id")
    ]
    twice = unknowns.groupBy("query_id", "unknown_id").count().filter("count > 1").select("query_id")
    followers = unknown_edges.select("query_id", F.col("next_id").alias("unknown_id"), F.lit(1).alias("follows")).distinct()
    heads = (
        unknowns.join(followers, ["query_id", "unknown_id"], "left")
        .groupBy("query_id")
        .agg(F.count_if(F.col("follows").isNull()).alias("heads"))
        .filter("heads <> 1")
        .select("query_id")
    )
    bad = heads
    for rows in (stray, twice, *branch):
        bad = bad.unionByName(rows)
    _no_chain(bad)


def _no_chain(bad: DataFrame) -> None:
    first = bad.limit(1).collect()
    if first:
        raise ValueError(f"the unknowns of query {first[0][0]} do not form one chain")


def decompose_query(unknowns: DataFrame, known_edges: DataFrame, unknown_edges: DataFrame) -> Batch:
    """Turn query graphs into star tables.

    ``unknowns``       (query_id, unknown_id, dst_type)
    ``known_edges``    (query_id, unknown_id, seed_id, seed_type)
    ``unknown_edges``  (query_id, unknown_id, next_id): the chain of unknowns

    ``star_id`` is the place in the chain. The number of joins is the length of the
    longest chain, which one count gives beforehand. A query whose unknowns do not form
    one chain (a cycle, a branch, two heads, an edge to no unknown) is an error.
    """
    chain = ["query_id", "unknown_id"]
    check_chains(unknowns, unknown_edges)
    ws = Workspace(unknowns.sparkSession, "decompose")
    followers = unknown_edges.select("query_id", F.col("next_id").alias("unknown_id"))
    heads = unknowns.join(followers, chain, "left_anti")
    steps = (
        unknown_edges.groupBy("query_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    )
    order = heads.select("query_id", F.array("unknown_id").alias("members"), F.col("unknown_id").alias("last"))
    after = unknown_edges.select("query_id", F.col("unknown_id").alias("last"), "next_id")
    for step in range(steps):
        order = order.join(after, ["query_id", "last"], "left").select(
            "query_id",
            F.when(F.col("next_id").isNull(), F.col("members"))
            .otherwise(F.array_append("members", F.col("next_id")))
            .alias("members"),
            F.col("next_id").alias("last"),
        )
        if step % 8 == 7:
            order, _ = ws.save(order, f"order-{step}")
    placed, _ = ws.save(
        order.select("query_id", F.posexplode("members").alias("star_id", "unknown_id")), "placed"
    )
    # What no head leads to lies on a cycle beside the chain.
    _no_chain(unknowns.join(placed, chain, "left_anti").select("query_id"))
    stars = unknowns.join(placed, chain).select("query_id", "star_id", "dst_type")
    seeds = known_edges.join(placed, chain).select("query_id", "star_id", "seed_id", "seed_type")
    return Batch(seeds, stars)
