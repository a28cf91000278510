"""Bound pruning: keep nodes that look hopeless from sending further.

Every pair is on the frontier exactly once, so leaving it out there is the same as
marking it, and only nodes that the hop touched are judged: their totals run along, as do the best complete nodes of
each star and the reached pairs of each link, so no hop reads the pairs of earlier ones. The upper bound sums visited seeds only and can drop true answers, which is
why pruning is off unless asked for. The thresholds found after a hop apply to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierwalk.operators.totals import NODE, STAR, Totals
from tierwalk.params import RANK_DIGITS, ScoreParams
from tierwalk.workspace import Workspace


def topk_thresholds(best: DataFrame, k: int) -> DataFrame:
    """Smallest lower bound and score among the k best complete nodes (``place``), for stars that
    have more than k of them."""
    return (
        best.groupBy(*STAR)
        .agg(
            F.min(F.when(F.col("place") <= k, F.col("lower_bound"))).alias("theta_bound"),
            F.min(F.when(F.col("place") <= k, F.col("score"))).alias("theta_score"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter(F.col("n") > k)
        .drop("n")
    )


def pair_thresholds(pairs: DataFrame, seed_scores: DataFrame, k: int) -> DataFrame:
    """For links: the overall minima over all reached (source, target) pairs, for links
    that have more than k of them."""
    bounds = pairs.groupBy(*NODE).agg(F.round(F.sum("lower_bound"), RANK_DIGITS).alias("bound"))
    rated = pairs.join(bounds, NODE).join(seed_scores, [*STAR, "seed_id"])
    return (
        rated.groupBy(*STAR)
        .agg(
            F.round(F.min(F.col("bound") + F.col("seed_score")), RANK_DIGITS).alias("theta_bound"),
            F.round(F.min("closeness"), RANK_DIGITS).alias("theta_score"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter(F.col("n") > k)
        .drop("n")
    )


class Pruner:
    """Judges the nodes of each new frontier."""

    def __init__(self, ws: Workspace, uses: DataFrame, keys, params: ScoreParams, targets: DataFrame | None, seed_scores: DataFrame | None):
        self.ws, self.uses, self.keys, self.params = ws, uses, list(keys), params
        self.targets, self.seed_scores = targets, seed_scores
        self.totals = Totals(ws, keys, sums=("score", "lower_bound", "upper_bound"))
        self.best: DataFrame | None = None
        self.pairs: list[str] = []

    def _star_thresholds(self, hop: int, touched: DataFrame) -> DataFrame:
        """From the k + 1 best complete nodes so far; the one beyond k tells whether there are more."""
        complete = (F.col("seen") == F.col("n_seeds")) & (F.col("seen_before") < F.col("n_seeds"))
        rows = touched.where(F.col("wanted") & complete).select(*NODE, "score", "lower_bound")
        if self.best is not None:
            rows = rows.unionByName(self.best.drop("place"))
        order = Window.partitionBy(*STAR).orderBy(F.desc("score"), "node_id")
        best = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= self.params.k + 1)
        self.best, _ = self.ws.save(best, f"best-{hop}")
        return topk_thresholds(self.best, self.params.k)

    def _link_thresholds(self, hop: int, new: DataFrame) -> DataFrame:
        """From the pairs at targets so far, k * k per link at most."""
        there = new.join(self.uses, self.keys).join(self.targets.select(*NODE), NODE, "left_semi")
        rows = there.select(*NODE, "seed_id", "closeness", "lower_bound")
        self.pairs.append(f"pairs-{hop}")
        self.ws.write(rows, self.pairs[-1])
        return pair_thresholds(self.ws.read(rows.schema, *self.pairs), self.seed_scores, self.params.k)

    def judge(self, hop: int, new: DataFrame, frontier: DataFrame) -> tuple[DataFrame, int]:
        """The frontier without suppressed nodes, and its row count."""
        rounded = {c: F.round(c, RANK_DIGITS) for c in ("score", "lower_bound", "upper_bound")}
        touched = self.totals.add(hop, new, self.uses).withColumns(rounded)
        found = self._star_thresholds(hop, touched) if self.targets is None else self._link_thresholds(hop, new)
        hopeless = (F.col("upper_bound") != 0) & (F.col("upper_bound") <= F.col("theta_bound"))
        beaten = (F.col("seen") == F.col("n_seeds")) & (F.col("score") <= F.col("theta_score"))
        blocked = touched.join(found, STAR).filter(hopeless | beaten)
        return self.ws.save(frontier.join(blocked, NODE, "left_anti"), f"frontier-{hop}")

    def close(self) -> None:
        self.totals.close()
