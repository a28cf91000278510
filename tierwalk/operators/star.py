"""Star queries: rank the nodes of a wanted type by summed closeness to all seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierwalk.operators.batch import Batch, Seeds, star_batch
from tierwalk.operators.graph import Graph, with_names
from tierwalk.operators.visit import Visit, seen_by_star, star_visit
from tierwalk.params import RANK_DIGITS, Domain, ScoreParams

STAR = ["query_id", "star_id"]


def score_nodes(visit: Visit) -> DataFrame:
    """Per star and wanted-type node: summed closeness and bounds, seeds that reached it."""
    return (
        seen_by_star(visit)
        .filter(F.col("type_id") == F.col("dst_type"))
        .groupBy(*STAR, "node_id")
        .agg(
            F.min("type_id").alias("type_id"),
            F.sum("closeness").alias("score"),
            F.sum("lower_bound").alias("lower_bound"),
            F.sum("upper_bound").alias("upper_bound"),
            F.count(F.lit(1)).alias("seen"),
            F.max("n_seeds").alias("n_seeds"),
        )
    )


def candidates(visit: Visit) -> DataFrame:
    """Nodes of the wanted type reached from every seed."""
    return score_nodes(visit).filter(F.col("seen") == F.col("n_seeds")).drop("seen", "n_seeds")


def top_k(scored: DataFrame, k: int, group: list[str], tie: str) -> DataFrame:
    """Best k per group by score, ties by ``tie`` ascending; adds ``rank``.

    Spark keeps k rows per group and task before the shuffle, so a group of any size
    never meets in one task.
    """
    order = Window.partitionBy(*group).orderBy(F.desc(F.round("score", RANK_DIGITS)), tie)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def batch_star_query(
    graph: Graph, batch: Batch, domain: Domain, params: ScoreParams, k: int | None = None
) -> DataFrame:
    """Answers of every star of a batch, from one visit; ``k`` goes before ``params.k``."""
    params = params.with_(k=k or params.k)
    visit = star_visit(graph, batch, domain, params, answers_only=True)
    return star_answers(visit, params.k)


def star_answers(visit: Visit, k: int) -> DataFrame:
    return top_k(candidates(visit), k, STAR, "node_id").select(
        *STAR, "rank", "node_id", "type_id", "score", "lower_bound", "upper_bound"
    )


def star_query(
    graph: Graph, seeds: Seeds, dst_type: int, domain: Domain, params: ScoreParams
) -> DataFrame:
    """One star query, answers with node names."""
    batch = star_batch(graph.spark, seeds, dst_type)
    return with_names(batch_star_query(graph, batch, domain, params), graph, rows=params.k)


def answer_details(visit: Visit, answers: DataFrame) -> DataFrame:
    """Answers with one struct per seed: how the seed reached the node."""
    part = F.struct(
        "seed_id", "dist", "n_paths", "hier", "closeness", "lower_bound", "upper_bound", "parent_id"
    )
    details = (
        seen_by_star(visit, answers)
        .join(answers.select(*STAR, "node_id"), [*STAR, "node_id"], "left_semi")
        .groupBy(*STAR, "node_id")
        .agg(F.sort_array(F.collect_list(part)).alias("detail"))
    )
    return answers.join(details, [*STAR, "node_id"])


def compare_hierarchy(graph: Graph, batch: Batch, domain: Domain, params: ScoreParams) -> DataFrame:
    """Answers with and without inheritance side by side.

    Every star is asked twice in one batch, so both share one visit, and the walks that do not inherit either way."""
    flags = F.array(F.struct(F.lit(0).alias("off"), F.lit(True).alias("hierarchy")), F.struct(F.lit(1).alias("off"), F.lit(False).alias("hierarchy")))
    twice = (2 * F.col("star_id")).alias("star_id")
    stars = batch.stars.select("*", F.inline(flags)).withColumn("star_id", 2 * F.col("star_id") + F.col("off")).drop("off")
    first = batch.seeds.select("query_id", twice, "seed_id", "seed_type")
    seeds = first.unionByName(first.withColumn("star_id", F.col("star_id") + 1))
    answers = batch_star_query(graph, Batch(seeds, stars), domain, params)

    def side(off: int, suffix: str) -> DataFrame:
        return answers.where(F.col("star_id") % 2 == off).select(
            "query_id",
            (F.col("star_id") / 2).cast("int").alias("star_id"),
            "node_id",
            F.col("rank").alias(f"rank_{suffix}"),
            F.col("score").alias(f"score_{suffix}"),
        )

    return side(0, "on").join(side(1, "off"), [*STAR, "node_id"], "full")
