"""General queries: a chain of unknowns, each with its own star.

All stars of all queries share one visit, and so do all links: the link from star i to
star i+1 is seeded with the answers of star i and aimed at the answers of star i+1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierwalk.operators.batch import Batch
from tierwalk.operators.graph import Graph
from tierwalk.operators.star import STAR, batch_star_query, top_k
from tierwalk.operators.visit import Near, Visit, seen_by_star, star_visit
from tierwalk.params import RANK_DIGITS, Domain, ScoreParams
from tierwalk.workspace import Workspace


# Totals of tuples, at ranking precision.
TOTAL = f"decimal(28, {RANK_DIGITS})"


def star_scores(answers: DataFrame, node: str, score: str) -> DataFrame:
    """Star score of a node at its chain position."""
    return answers.select(*STAR, F.col("node_id").alias(node), F.col("score").alias(score))


def link_visit(
    graph: Graph, batch: Batch, answers: DataFrame, domain: Domain, params: ScoreParams, taken: Near | None = None
) -> tuple[Visit, DataFrame]:
    """The walk from the answers of each star to those of the next, and its targets.

    ``taken`` are the steps back from the targets that an earlier walk took."""
    following = batch.stars.select("query_id", (F.col("star_id") - 1).alias("star_id"), "dst_type")
    links = following.filter(F.col("star_id") >= 0)
    seeds = answers.join(links, STAR, "left_semi").select(
        *STAR, F.col("node_id").alias("seed_id"), F.col("type_id").alias("seed_type")
    )
    targets = answers.filter(F.col("star_id") > 0).select(
        "query_id", (F.col("star_id") - 1).alias("star_id"), "node_id", F.col("score").alias("target_score")
    )
    visit = star_visit(
        graph,
        Batch(seeds, links),
        domain,
        params.with_(early_stop=False),
        targets=targets.select(*STAR, "node_id"),
        seed_scores=star_scores(answers, "seed_id", "seed_score"),
        answers_only=True,
        taken=taken,
    )
    return visit, targets


# Bounds under which links are tried first: all that is walked then leads to a target.
SHORT_LINKS = (3, 4)


def shortest_links(
    graph: Graph, batch: Batch, answers: DataFrame, domain: Domain, params: ScoreParams
) -> tuple[DataFrame, DataFrame]:
    """The pairs of source and target that ``link_visit`` reaches, as seen by their stars, and the targets.

    A pair is the same under any bound that reaches it, so a short bound is enough for a link of which all pairs are reached
    under it. The others start again with a longer one, at last with their own. No link looks at another, also not under pruning.
    """
    short = SHORT_LINKS if params.stop == "fixpoint" else ()
    bounds = [b for b in short if params.max_hops is None or b < params.max_hops]
    found, known = [], ()
    for bound in (*bounds, params.max_hops):
        visit, targets = link_visit(graph, batch, answers, domain, params.with_(max_hops=bound), *known)
        seen, known = seen_by_star(visit, targets), (visit.near,)
        if visit.linked or bound == params.max_hops:
            found.append(seen)
            break
        if visit.stops is not None:
            ended = visit.stops.select(*STAR)
            found.append(seen.join(ended, STAR, "left_semi"))
            # A link is there because of the star it leads to.
            led = ended.withColumn("star_id", F.col("star_id") + 1)
            batch = Batch(batch.seeds, batch.stars.join(led, STAR, "left_anti"))
    return reduce(DataFrame.unionByName, found), targets


def link_candidates(
    graph: Graph, batch: Batch, answers: DataFrame, domain: Domain, params: ScoreParams
) -> DataFrame:
    """Pairs (source answer of star i, target answer of star i+1) with their closeness.

    ``pair_score`` is star score of the source plus closeness; ``star_id`` is i.
    """
    sources = star_scores(answers, "source_id", "source_score")
    seen, targets = shortest_links(graph, batch, answers, domain, params)
    reached = seen.select(*STAR, F.col("seed_id").alias("source_id"), "node_id", "closeness")
    pairs = (
        reached.join(targets, [*STAR, "node_id"])
        .join(sources, [*STAR, "source_id"])
        .select(
            *STAR,
            "source_id",
            F.col("node_id").alias("target_id"),
            "closeness",
            (F.col("source_score") + F.col("closeness")).alias("pair_score"),
            "target_score",
        )
    )
    if params.distinct_nodes:
        pairs = pairs.filter(F.col("source_id") != F.col("target_id"))
    return pairs


def keep_leading(tuples: DataFrame, k: int) -> DataFrame:
    """The k best partial tuples per last node; no continuation can bring another into the top k.

    Tuples with the same last node gain the same by every continuation. Totals are
    fixed-point, so their order, and the order of ids among equals, carries over.
    """
    best = Window.partitionBy("query_id", "last_id").orderBy(F.desc("score"), "node_ids")
    return tuples.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).drop("place")


def extend_chain(tuples: DataFrame, links: DataFrame, star_id: int, k: int) -> DataFrame:
    """Append the next unknown to tuples that end at chain position ``star_id``."""
    step = links.filter(F.col("star_id") == star_id).select(
        "query_id",
        F.col("source_id").alias("last_id"),
        "target_id",
        (F.col("closeness") + F.col("target_score")).cast(TOTAL).alias("gain"),
    )
    longer = tuples.join(step, ["query_id", "last_id"]).select(
        "query_id",
        F.col("target_id").alias("last_id"),
        F.array_append("node_ids", F.col("target_id")).alias("node_ids"),
        (F.col("score") + F.col("gain")).cast(TOTAL).alias("score"),
    )
    return keep_leading(longer, k)


def join_chain(
    ws: Workspace, batch: Batch, answers: DataFrame, links: DataFrame, k: int
) -> DataFrame:
    """Best k tuples of every query: node ids in chain order and total score."""
    lengths = batch.stars.groupBy("query_id").agg((F.max("star_id") + 1).alias("n_stars"))
    longest = lengths.agg(F.max("n_stars")).first()[0] or 0
    tuples = answers.filter(F.col("star_id") == 0).select(
        "query_id", F.col("node_id").alias("last_id"), F.array("node_id").alias("node_ids"), F.col("score").cast(TOTAL).alias("score")
    )
    finished = []
    for n in range(1, longest + 1):
        if n > 1:
            tuples = extend_chain(tuples, links, n - 2, k)
            if n < longest:
                tuples, _ = ws.save(tuples, f"tuples-{n}")
        done = lengths.filter(F.col("n_stars") == n)
        finished.append(tuples.join(done, "query_id", "left_semi"))
    if not finished:
        return tuples.select("query_id", F.lit(1).alias("rank"), "node_ids", F.col("score").cast("double"))
    totals = finished[0]
    for rows in finished[1:]:
        totals = totals.unionByName(rows)
    ranked = top_k(totals, k, ["query_id"], "node_ids")
    return ranked.select("query_id", "rank", "node_ids", F.col("score").cast("double").alias("score"))


def general_query(
    graph: Graph, batch: Batch, domain: Domain, params: ScoreParams, k: int | None = None
) -> DataFrame:
    """Top k tuples of every chain of a batch; a chain of one star gives its answers."""
    ws = Workspace(graph.spark, "chain")
    k = k or params.k
    star_k = params.star_k or k
    answers, _ = ws.save(
        batch_star_query(graph, batch, domain, params.with_(k=star_k)), "answers"
    )
    links, _ = ws.save(link_candidates(graph, batch, answers, domain, params.with_(k=k)), "links")
    return join_chain(ws, batch, answers, links, k)
