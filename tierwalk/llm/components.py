"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.workspace import Workspace


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Edges (hi, lo), hi > lo. Large star: every node's larger neighbours move to the least of its neighbourhood.
    Small star: its smaller ones, and the node itself, do."""
    if both_ways:
        around = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
    else:
        around = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = around.join(least, "u")
    if both_ways:
        out = joined.where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        out = joined.select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionByName(
            least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))
        )
    return out.where("hi > lo").distinct()


def components(links: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(node, component) of every node in links (a, b), component being the least node reachable.

    Each round is written to the shared folder. A hub is one key of a join and two sums with partial
    aggregation, so Spark splits or combines it; no neighbourhood is ever gathered.
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct()
    edges, count = space.save(edges, f"{name}-0")
    step, before = 0, None
    while count:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before, step = state, step + 1
        edges, count = space.save(_stars(_stars(edges, True), False), f"{name}-{step}")
    tops = edges.groupBy("hi").agg(F.min("lo").alias("component"))
    return tops.select(F.col("hi").alias("node"), "component").unionByName(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
