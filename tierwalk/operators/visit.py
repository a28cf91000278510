"""The visit: level by level from many seeds at once. The only loop over the graph.

What a seed reaches depends on the seed and on whether it inherits, not on the query
that asks, so a workload walks once per (seed_id, inherits) and every star reads the
walks it needs. Only with bound pruning does a star steer its own walks; then the star
is part of the walk key.

State is append-only: a pair (walk, node) gets its row at the hop that first reaches it
and never changes. Each hop is one job that appends its new rows to a table in the shared folder, kept in
buckets of (walk, node) like the reduce of a hop, so earlier hops are read but never shuffled again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.functions import closeness, edge_weight, inherits, lower_bound, upper_bound
from tierwalk.operators.batch import Batch, small_table
from tierwalk.operators.filled import Filled
from tierwalk.operators.graph import BROADCAST_ROWS, BUCKET_IDS, Graph, few_ids, only_ids, slot
from tierwalk.operators.pruning import Pruner
from tierwalk.operators.stopping import CoverageRule, EarlyRule, LinkRule, Rule, check_levels
from tierwalk.params import Domain, ScoreParams
from tierwalk.workspace import Log, Workspace, setting

SHARED = ("seed_id", "inherits")
PER_STAR = ("query_id", "star_id", "seed_id", "inherits")

# Wanted types that become literals of the last hop's scan.
WANTED_TYPES = 100
# Frontier rows a task may hold as a hash table; the edges then stream past unsorted.
HASH_ROWS = 1_000_000
# Walks that must stand on a node before its edges go to them instead of them to the edges; how many such nodes and edges at most.
HOT_WALKS, HOT_NODES, HOT_EDGES = 10_000, 1_000, 1_000_000
# Frontier rows from which on a hop goes walk by walk in several turns, and how many at most: each reads the edges again.
TURN_ROWS, TURNS = 400_000, 4


@dataclass
class Near:
    """Nodes with a target at most 0, 1, ... hops ahead, the last step back that was taken and its rows."""

    found: list[DataFrame] = field(default_factory=list)
    last: DataFrame | None = None
    rows: int = 0


@dataclass(frozen=True)
class Visit:
    """Result of a walk.

    ``uses``   which star reads which walk: query_id, star_id, seed_id, seed_type,
               inherits, dst_type, n_seeds
    ``state``  visited pairs: walk key, node_id, type_id, n_paths (a double: exact
               below 2^53, then to 53 bits), hier, closeness, lower_bound,
               upper_bound, parent_id, dist
    ``stops``  last hop that counts per star, for the stop rules that end stars apart
    ``hops``   new rows per hop
    ``linked`` for links: every source has reached every target
    ``near``   for links: the steps back from the targets that were taken
    """

    uses: DataFrame
    state: DataFrame
    keys: tuple[str, ...]
    params: ScoreParams
    stops: DataFrame | None
    hops: tuple[int, ...]
    linked: bool = False
    near: Near | None = None


def star_uses(batch: Batch, domain: Domain, params: ScoreParams) -> DataFrame:
    """One row per star and distinct seed, with the inheritance decision for the pair.

    Stars with a column ``hierarchy`` decide for themselves, those without go by the parameters."""
    star = ["query_id", "star_id"]
    seeds = batch.seeds.groupBy(*star, "seed_id").agg(F.min("seed_type").alias("seed_type"))
    sizes = seeds.groupBy(*star).agg(F.count(F.lit(1)).cast("int").alias("n_seeds"))
    decided = inherits(F.col("seed_type"), F.col("dst_type"), domain, params.hierarchy)
    if "hierarchy" in batch.stars.columns:
        decided = F.col("hierarchy") & inherits(F.col("seed_type"), F.col("dst_type"), domain, True)
    return seeds.join(batch.stars, star).join(sizes, star).withColumn("inherits", decided).drop("hierarchy")


def init_frontier(uses: DataFrame, graph: Graph, keys, ids: list[int]) -> DataFrame:
    """One state row per walk: its seed at distance 0, if the graph has that node."""
    nodes = only_ids(graph.nodes.select("node_id", "type_id"), "node_id", ids)
    starts = uses.select(*keys).distinct().withColumn("node_id", F.col("seed_id"))
    return starts.join(nodes, "node_id").select(
        *keys,
        "node_id",
        "type_id",
        F.lit(1.0).alias("n_paths"),
        F.lit(0.0).alias("hier"),
        F.lit(0.0).alias("closeness"),
        F.lit(1.0).alias("lower_bound"),
        F.lit(1.0).alias("upper_bound"),
        F.lit(None).cast("bigint").alias("parent_id"),
    )


def wanted_edges(edges: DataFrame, uses: DataFrame) -> DataFrame:
    """Edges into nodes of a wanted type."""
    types = uses.select("dst_type").distinct()
    few = [r[0] for r in types.limit(WANTED_TYPES + 1).collect()]
    if len(few) > WANTED_TYPES:
        return edges.join(types.withColumnRenamed("dst_type", "wanted"), F.col("dst_type") == F.col("wanted"), "left_semi")
    return edges.filter(F.col("dst_type").isin(*few)) if few else edges


def meet_edges(steps: DataFrame, rows: int, walks: int, graph: Graph) -> DataFrame:
    """Out-edges of the nodes of a frontier: steps(node, ...) joined to the edges.

    ``rows`` and ``walks`` are the counts of frontier rows and of walks; they decide
    how the two meet.
    """
    edges, frontier_rows = graph.edges if graph.stored is None else graph.stored, rows
    if graph.hubs is None:
        key, steps = "src", steps.withColumn("key", F.col("node"))
        same = edges["src"] == steps["key"]
    else:
        hubs = graph.hubs.withColumnRenamed("src", "node")
        hubs = F.broadcast(hubs) if graph.hubs_bounded else hubs
        pieces = F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)
        steps = steps.join(hubs, "node", "left").withColumn("piece", F.explode(pieces))
        steps = steps.withColumn("key", slot("node", F.col("piece"))).drop("pieces", "piece")
        key = "slot"
        # Each walk meets each piece at most once.
        rows += min(rows, walks) * graph.n_pieces
        # Sources that share a slot are told apart without a second join key, which the
        # buckets could not serve.
        same = (edges["slot"] == steps["key"]) & (edges["src"].bitwiseXOR(steps["node"]) == 0)

    edges = only_ids(edges, key, few_ids(steps, "key", frontier_rows, graph.id_limit))
    if rows <= BROADCAST_ROWS:
        steps = F.broadcast(steps)
    elif graph.buckets and rows / graph.buckets + walks <= HASH_ROWS:
        steps = steps.hint("shuffle_hash")
    met = edges.join(steps, same)
    if graph.removed is not None:
        gone = graph.removed.select(F.col("src").alias("gone_src"), F.col("dst").alias("gone_dst"))
        # On the frontier's name for the source: a condition on edges alone would be pushed below the join and shuffle them all.
        met = met.join(gone, (F.col("node") == F.col("gone_src")) & (F.col("dst") == F.col("gone_dst")), "left_anti")
    return met


def hot_nodes(steps: DataFrame, graph: Graph) -> tuple[list[int], DataFrame | None]:
    """Nodes of a frontier on which many walks stand, busiest first, and their edges: together ``HOT_EDGES`` at most.

    Hubs are not among them: the layout deals their edges, and each piece meets the walks by itself.
    """
    crowds = steps.groupBy("node").agg(F.count(F.lit(1)).alias("walks")).filter(F.col("walks") > HOT_WALKS)
    if graph.hubs is not None:
        crowds = crowds.join(graph.hubs.select(F.col("src").alias("node")), "node", "left_anti")
    found = [r["node"] for r in crowds.orderBy(F.desc("walks"), "node").limit(HOT_NODES).collect()]
    if not found:
        return [], None
    nodes = small_table(graph.spark, {"node": pa.int64()}, [(n,) for n in found])
    arcs = meet_edges(nodes, len(found), 1, graph).select("src", "dst", "dst_type", "level")
    degree = {r["src"]: r["count"] for r in arcs.groupBy("src").count().collect()}
    hot, edges = [], 0
    for node in found:
        if edges + degree.get(node, 0) <= HOT_EDGES:
            hot.append(node)
            edges += degree.get(node, 0)
    return hot, arcs.filter(F.col("src").isin(*hot)) if hot else None


def meet(steps: DataFrame, rows: int, walks: int, graph: Graph) -> DataFrame:
    """As ``meet_edges``, with src, dst, dst_type and level of the edges only, and no node as a single key of many walks.

    A frontier that has to be shuffled to the edges would bring all walks on a node into one task. The walks on the
    busiest nodes stay where they are, spread like the state they come from, and the edges of these nodes are broadcast.
    """
    columns = [*steps.columns, "src", "dst", "dst_type", "level"]
    # A walk is on a node once, so fewer walks cannot make a crowd.
    hot, arcs = hot_nodes(steps, graph) if rows > BROADCAST_ROWS and walks > HOT_WALKS else ([], None)
    if not hot:
        return meet_edges(steps, rows, walks, graph).select(*columns)
    crowded = F.col("node").isin(*hot)
    apart = steps.filter(crowded).join(F.broadcast(arcs), F.col("node") == F.col("src"))
    return meet_edges(steps.filter(~crowded), rows, walks, graph).select(*columns).unionByName(apart.select(*columns))


def propagate(
    frontier: DataFrame,
    rows: int,
    walks: int,
    visited: DataFrame,
    graph: Graph,
    keys,
    hop: int,
    params: ScoreParams,
    ends: DataFrame | None = None,
    full: DataFrame | None = None,
) -> DataFrame:
    """One hop: send along the out-edges, reduce per (walk, node), keep the new pairs.

    ``rows`` and ``walks`` are the counts of frontier rows and of walks. With ``ends(node_id)``
    only pairs at those nodes are kept; what was sent is narrowed, so that the edges stay where they are.
    ``full(walk key, dst_type)`` tells of which types a walk has every node; nothing is sent there.

    The partial aggregation runs before the shuffle, so a node with many parents costs
    one row per task. The visited pairs are keyed like the groups and join in place.
    """
    steps = frontier.select(*keys, F.col("node_id").alias("node"), "n_paths", "hier", "lower_bound")
    weight = edge_weight(F.col("level"), params)
    met = meet(steps, rows, walks, graph)
    if full is not None:
        met = met.join(F.broadcast(full), [*keys, "dst_type"], "left_anti")
    sent = met.select(
        *keys,
        F.col("dst").alias("node_id"),
        "dst_type",
        "n_paths",
        (F.col("hier") + F.when(F.col("inherits"), weight).otherwise(F.lit(0.0))).alias("hier"),
        weight.alias("edge"),
        "lower_bound",
        "src",
    )
    if ends is not None:
        sent = sent.join(ends, "node_id", "left_semi")
    reduced = sent.groupBy(*keys, "node_id").agg(
        F.min("dst_type").alias("type_id"),
        F.sum("n_paths").alias("n_paths"),
        F.max("hier").alias("hier"),
        F.max("edge").alias("edge"),
        F.sum("lower_bound").alias("parents_bound"),
        F.min("src").alias("parent_id"),
    )
    fresh = reduced.join(visited.select(*keys, "node_id"), [*keys, "node_id"], "left_anti")

    dist, hier = F.lit(hop), F.col("hier")
    parent_hier = hier - F.col("edge")
    scored = fresh.withColumns(
        {
            "closeness": closeness(dist, F.col("n_paths"), parent_hier, hier, params),
            # A pair has no bound before its first visit.
            "lower_bound": lower_bound(
                F.lit(0.0), dist, parent_hier, F.col("parents_bound"), F.col("edge"), params
            ),
        }
    )
    return scored.select(
        *keys,
        "node_id",
        "type_id",
        "n_paths",
        "hier",
        "closeness",
        "lower_bound",
        upper_bound(F.col("lower_bound"), dist, hier, params).alias("upper_bound"),
        "parent_id",
    )


def turns(frontier: DataFrame, rows: int, walks: int, keys) -> list[tuple[DataFrame, int]]:
    """A frontier dealt by walk into parts that take a hop one after another, each with its rows, about.

    What is sent in a hop is on disk, and in the maps of its tasks, until it is reduced and written; of a large frontier only
    a part is at a time. Walks do not meet, so it is the same hop."""
    n = min(TURNS, walks, -(-rows // TURN_ROWS))
    if n <= 1:
        return [(frontier, rows)]
    turn = F.pmod(F.xxhash64(*keys), F.lit(n))
    return [(frontier.where(turn == i), -(-rows // n)) for i in range(n)]


def near_targets(ws: Workspace, graph: Graph, targets: DataFrame, hops: int, at: Near) -> list[DataFrame]:
    """Nodes with a target at most 0, 1, ... ``hops`` hops ahead, up to where they are too many to be broadcast.

    Each step back is one pass over the two ids of the edges, except those that ``at`` has from an earlier walk, which had these
    targets or more. Edges that were removed count too. Either way more nodes are near than have to be.
    """
    edges = (graph.edges if graph.stored is None else graph.stored).select("src", "dst")
    if at.last is None:
        at.last, at.rows = ws.save(targets.select("node_id").distinct(), "near-0")
        at.found.append(F.broadcast(at.last) if at.rows <= BROADCAST_ROWS else at.last)
    while len(at.found) <= hops and at.rows <= BROADCAST_ROWS:
        into = only_ids(edges, "dst", few_ids(at.last, "node_id", at.rows, BUCKET_IDS))
        heads = F.broadcast(at.last.select(F.col("node_id").alias("dst")))
        behind = into.join(heads, "dst", "left_semi").select(F.col("src").alias("node_id"))
        # One row too many tells that they are too many.
        some = behind.union(at.last).distinct().limit(BROADCAST_ROWS + 1)
        at.last, at.rows = ws.save(some, f"near-{len(at.found)}")
        if at.rows <= BROADCAST_ROWS:
            at.found.append(F.broadcast(at.last))
    return at.found[: max(hops, 0) + 1]


def star_visit(
    graph: Graph,
    batch: Batch,
    domain: Domain,
    params: ScoreParams,
    targets: DataFrame | None = None,
    seed_scores: DataFrame | None = None,
    answers_only: bool = False,
    taken: Near | None = None,
) -> Visit:
    """Walk from all seeds of a batch.

    ``answers_only`` leaves out what cannot lead to one of the k answers. At ``max_hops`` these are the nodes
    that can be none: nobody walks on from there, and the last hop is the largest. For links they are, at every hop,
    the nodes from which no target can be reached in the hops left. Stars end like with ``early_stop``, once no
    other node can enter their k best, if the layout knows that its levels allow it.
    ``targets``      (query_id, star_id, node_id): wanted nodes, in place of all nodes of
                     the wanted type (links of a chain)
    ``seed_scores``  (query_id, star_id, seed_id, seed_score): star scores of link seeds,
                     for the thresholds of a link under bound pruning
    ``taken``        steps back from these targets, or more, that an earlier walk took
    """
    # Reduces and logs are dealt at least as finely as the edges, so that a task holds as much on a larger graph.
    parts = max(int(graph.spark.conf.get("spark.sql.shuffle.partitions")), graph.buckets or 0)
    with setting(graph.spark, "spark.sql.shuffle.partitions", str(parts)):
        return _walk(graph, batch, domain, params, targets, seed_scores, answers_only, taken)


def _walk(graph, batch, domain, params, targets, seed_scores, answers_only, taken) -> Visit:
    keys = PER_STAR if params.prune else SHARED
    ws = Workspace(graph.spark, "visit")
    uses, n_uses = ws.save(star_uses(batch, domain, params), "uses")

    if n_uses <= BROADCAST_ROWS:
        uses = F.broadcast(uses)
    ids = few_ids(uses, "seed_id", n_uses, graph.id_limit)

    start = init_frontier(uses, graph, keys, ids)
    log = Log(ws, "state", start.schema, [*keys, "node_id"], "dist")
    rule: Rule | None = None
    pruner = Pruner(ws, uses, keys, params, targets, seed_scores) if params.prune else None
    watched = {}
    try:
        rows = log.append(start, 0)[0]
        filled = Filled(ws, graph, keys, rows)
        # Few stars are decided before their second hop: those that end by themselves are judged from there on.
        judged_from = 1
        if params.early_stop:
            check_levels(graph)
            rule = EarlyRule(ws, uses, keys, params)
        elif params.stop == "coverage":
            rule = CoverageRule(ws, graph, uses, keys, targets)
        elif targets is not None and (answers_only or not params.prune):
            rule = LinkRule(ws, uses, log.upto(0), keys, targets)
            few = few_ids(targets, "node_id", 0, BUCKET_IDS)
            watched = {"hits": F.col("node_id").isin(*few)} if few else {}
        elif answers_only and graph.odd_levels == 0 and (params.max_hops is None or params.max_hops > 2):
            # Also under pruning: it keeps pairs from being visited, and a pair visited later is under the same cap.
            rule, judged_from = EarlyRule(ws, uses, keys, params), 2

        hops, hop, hits = [rows], 0, None
        last = params.max_hops if answers_only else None
        near, at = [], taken or Near()
        if last and targets is not None:
            # The coverage rule counts the nodes visited before the last hop.
            near = near_targets(ws, graph, targets, 0 if params.stop == "coverage" else last - 2, at)
        while rows and (params.max_hops is None or hop < params.max_hops):
            frontier = log.upto(hop, hop)
            # Seeds count with the first hop.
            new = frontier if hop > 1 else log.upto(1)
            if hop and pruner:
                frontier, rows = pruner.judge(hop, new, frontier)
            if hop >= judged_from and rule:
                rule.after(hop, new if hop > judged_from else log.upto(hop), hits)
                if not rule.running:
                    break
                if rule.stops is not None:
                    active = rule.running_uses().select(*keys).distinct()
                    frontier = frontier.join(active, list(keys), "left_semi")
            reach, ends = graph, None
            if near:
                left = last - hop - 1
                ends = near[left] if left < len(near) else None
            elif hop + 1 == last:
                reach = graph.edges_where(lambda edges: wanted_edges(edges, uses))
            full = filled.after(hop, log)
            if filled.everywhere:
                hop, rows, hits = hop + 1, 0, 0
                hops.append(rows)
                break
            if filled.types:
                reach = reach.edges_where(lambda edges: edges.filter(~F.col("dst_type").isin(*filled.types)))
            counts = []
            for some, n in turns(frontier, rows, hops[0], keys):
                fresh = propagate(some, n, hops[0], log.upto(hop), reach, keys, hop + 1, params, ends, full)
                counts.append(log.append(fresh, hop + 1, **watched))
            hop += 1
            rows, *found = map(sum, zip(*counts))
            hits = found[0] if found else None
            hops.append(rows)
        linked = isinstance(rule, LinkRule)
        if linked and rule.running and hop:
            rule.after(hop, log.upto(hop, hop) if hop > 1 else log.upto(1), hits)
        linked = linked and not rule.running
    finally:
        for kept in (rule, pruner, log):
            if kept:
                kept.close()
    return Visit(uses, log.rows(), keys, params, rule.stops if rule else None, tuple(hops), linked, at)


def seen_by_star(visit: Visit, nodes: DataFrame | None = None) -> DataFrame:
    """The state as each star sees it: one row per (star, seed, visited node).

    With ``nodes(node_id)`` only those nodes; they are cut out before the state fans
    out to the stars.
    """
    rows = visit.state
    if nodes is not None:
        rows = rows.join(nodes.select("node_id").distinct(), "node_id", "left_semi")
    rows = rows.join(visit.uses, list(visit.keys))
    if visit.stops is not None:
        rows = rows.join(visit.stops, ["query_id", "star_id"], "left").filter(
            F.col("dist") <= F.coalesce("last_hop", F.col("dist"))
        ).drop("last_hop")
    return rows


def visited_any(visit: Visit) -> DataFrame:
    """Nodes reached from at least one seed of the star."""
    return seen_by_star(visit).select("query_id", "star_id", "node_id").distinct()


def visit_metrics(visit: Visit) -> DataFrame:
    """New pairs per hop."""
    rows = list(enumerate(visit.hops))
    return visit.uses.sparkSession.createDataFrame(rows, "hop int, new_pairs bigint")
