"""Stop rules that end the stars of a batch one by one.

A rule is fed the new pairs of each hop and keeps what it needs of the earlier ones: counts per star, or totals per (star, node).
It returns ``stops(query_id, star_id, last_hop)``, one row per ended star, and the
number of stars still running. State rows beyond a star's last hop do not count for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierwalk.functions import unvisited_cap
from tierwalk.operators.graph import Graph, type_counts
from tierwalk.operators.totals import STAR, Totals
from tierwalk.params import RANK_DIGITS, ScoreParams
from tierwalk.workspace import Workspace


def star_totals(uses: DataFrame, graph: Graph, targets: DataFrame | None) -> DataFrame:
    """Per star: number of wanted nodes and of all nodes."""
    sizes = type_counts(graph)
    n_nodes = sizes.agg(F.sum("n_nodes").alias("n")).select("n")
    stars = uses.select(*STAR, "dst_type").distinct()
    if targets is None:
        wanted = stars.join(
            sizes.select(F.col("type_id").alias("dst_type"), F.col("n_nodes").alias("n_wanted")),
            "dst_type",
            "left",
        )
    else:
        wanted = stars.join(targets.groupBy(*STAR).agg(F.count(F.lit(1)).alias("n_wanted")), STAR, "left")
    return wanted.select(
        *STAR, F.coalesce("n_wanted", F.lit(0)).alias("n_wanted"), n_nodes.scalar().alias("n_nodes")
    )


def pair_totals(uses: DataFrame, start: DataFrame, keys, targets: DataFrame) -> DataFrame:
    """Per link: number of (source in the graph, target) pairs."""
    sources = uses.join(start.select(*keys), list(keys)).groupBy(*STAR).agg(F.count(F.lit(1)).alias("n_sources"))
    ends = targets.distinct().groupBy(*STAR).agg(F.count(F.lit(1)).alias("n_targets"))
    return (
        uses.select(*STAR)
        .distinct()
        .join(sources, STAR, "left")
        .join(ends, STAR, "left")
        .select(*STAR, (F.coalesce("n_sources", F.lit(0)) * F.coalesce("n_targets", F.lit(0))).alias("n_pairs"))
    )


class Rule:
    """Stars with a counter or more each, and ``last_hop`` once they have ended."""

    def __init__(self, ws: Workspace, stars: DataFrame, uses: DataFrame, keys):
        self.ws, self.uses, self.keys = ws, uses, list(keys)
        self.stars, self.running = ws.save(stars.withColumn("last_hop", F.lit(None).cast("int")), "stars")
        self.stops: DataFrame | None = None

    def running_uses(self) -> DataFrame:
        return self.uses if self.stops is None else self.uses.join(self.stops, STAR, "left_anti")

    def record(self, hop: int, stars: DataFrame, over) -> None:
        """Keep the counters after a hop; stars for which ``over`` holds have ended with it."""
        last = F.coalesce("last_hop", F.when(over, F.lit(hop))).alias("last_hop")
        kept = stars.select(*(c for c in self.stars.columns if c != "last_hop"), last)
        self.stars, n, ended = self.ws.save_counting(kept, f"stars-{hop}", F.col("last_hop").isNotNull())
        self.running = n - ended
        self.stops = self.stars.where(F.col("last_hop").isNotNull()).select(*STAR, "last_hop") if ended else None

    def close(self) -> None:
        pass


class CoverageRule(Rule):
    """End a star when its visited nodes stopped growing, when all wanted nodes are
    complete, or when every node of the graph is visited."""

    def __init__(self, ws: Workspace, graph: Graph, uses: DataFrame, keys, targets: DataFrame | None):
        none = F.lit(0).cast("bigint")
        super().__init__(ws, star_totals(uses, graph, targets).withColumns({"visited": none, "complete": none}), uses, keys)
        self.totals = Totals(ws, keys, targets)

    def after(self, hop: int, new: DataFrame, hits: int | None) -> None:
        touched = self.totals.add(hop, new, self.running_uses())
        completed = (F.col("seen") == F.col("n_seeds")) & (F.col("seen_before") < F.col("n_seeds"))
        grown = touched.groupBy(*STAR).agg(
            F.count_if(F.col("seen_before") == 0).alias("more"), F.count_if(F.col("wanted") & completed).alias("done")
        )
        stars = self.stars.join(grown, STAR, "left").withColumns(
            {
                "more": F.coalesce("more", F.lit(0)),
                "visited": F.col("visited") + F.coalesce("more", F.lit(0)),
                "complete": F.col("complete") + F.coalesce("done", F.lit(0)),
            }
        )
        # Before the first hop the count stands at zero, seeds included.
        still = (F.col("more") == 0) & (F.col("visited") > 0)
        over = still | (F.col("complete") >= F.col("n_wanted")) | (F.col("visited") >= F.col("n_nodes"))
        self.record(hop, stars, over)

    def close(self) -> None:
        self.totals.close()


class LinkRule(Rule):
    """End a link when every source has reached every target; a visited pair never changes, so this is exact."""

    def __init__(self, ws: Workspace, uses: DataFrame, start: DataFrame, keys, targets: DataFrame):
        stars = pair_totals(uses, start, keys, targets).withColumn("reached", F.lit(0).cast("bigint"))
        super().__init__(ws, stars, uses, keys)
        self.ends = targets.select(*STAR, "node_id").distinct()

    def after(self, hop: int, new: DataFrame, hits: int | None) -> None:
        if hits == 0 and hop > 1:
            return
        there = new.join(self.ends.select("node_id").distinct(), "node_id", "left_semi").join(self.running_uses(), self.keys)
        found = there.join(self.ends, [*STAR, "node_id"], "left_semi").groupBy(*STAR).agg(F.count(F.lit(1)).alias("n"))
        stars = self.stars.join(found, STAR, "left").withColumn("reached", F.col("reached") + F.coalesce("n", F.lit(0)))
        self.record(hop, stars, F.col("reached") >= F.col("n_pairs"))


class EarlyRule(Rule):
    """End a star when its k-th complete score is above anything still open.

    Open are wanted nodes reached from some seeds only, which may gain the cap of each
    missing seed, and untouched nodes, which may gain the cap of every seed. The answer
    equals that of the full walk, ties included.
    """

    def __init__(self, ws: Workspace, uses: DataFrame, keys, params: ScoreParams):
        super().__init__(ws, uses.select(*STAR).distinct(), uses, keys)
        self.totals, self.params = Totals(ws, keys, wanted_only=True, sums=("n_inherits", "score"), name="standings"), params

    def after(self, hop: int, new: DataFrame, hits: int | None) -> None:
        running = self.running_uses()
        self.totals.add(hop, new, running)
        nodes = self.totals.latest(hop)
        if self.stops is not None:
            nodes = nodes.join(self.stops, STAR, "left_anti")
        complete = F.col("seen") == F.col("n_seeds")
        cap = {flag: unvisited_cap(F.lit(hop), F.lit(flag), self.params) for flag in (True, False)}
        gain = F.col("score") - F.col("n_inherits") * cap[True] - (F.col("seen") - F.col("n_inherits")) * cap[False]
        # The k best complete nodes and the best open one of each star: k + 1 rows per task go to the shuffle.
        best = Window.partitionBy(*STAR, "complete").orderBy(F.desc("value"))
        ranked = nodes.select(*STAR, complete.alias("complete"), F.when(complete, F.col("score")).otherwise(gain).alias("value"))
        ranked = ranked.withColumn("place", F.row_number().over(best)).where(F.col("place") <= self.params.k)
        stands = ranked.groupBy(*STAR).agg(
            F.min(F.when(F.col("complete"), F.col("value"))).alias("kth"),
            F.count_if("complete").alias("n"),
            F.max(F.when(~F.col("complete"), F.col("value"))).alias("gain"),
        )
        caps = running.groupBy(*STAR).agg(F.sum(unvisited_cap(F.lit(hop), F.col("inherits"), self.params)).alias("caps"))
        open_best = F.col("caps") + F.greatest(F.coalesce("gain", F.lit(0.0)), F.lit(0.0))
        stars = self.stars.join(stands, STAR, "left").join(caps, STAR, "left")
        over = (F.col("n") == self.params.k) & (F.col("kth") > open_best + F.lit(10.0**-RANK_DIGITS))
        self.record(hop, stars, F.coalesce(over, F.lit(False)))

    def close(self) -> None:
        self.totals.close()


def check_levels(graph: Graph) -> None:
    """The caps hold for levels -1, 0 and 1. A layout knows its levels; else the filter reaches the scan."""
    odd = graph.odd_levels
    if odd or odd is None and not graph.edges.filter("level > 1 OR level < -1").isEmpty():
        raise ValueError("early_stop needs edge levels between -1 and 1")
