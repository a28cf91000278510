"""Running totals per (star, node), fed by the rows of each new hop only.

A row is logged for every hop that touched the node, with the totals up to that hop; the last one counts. What is added is
never negative, so that is the largest, which is aggregated by hashing. Stop rules and pruning read these in place of the
visited pairs, each with the sums it needs only: nodes touched by a hop meet their earlier totals bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.workspace import Log, Workspace

STAR = ["query_id", "star_id"]
NODE = [*STAR, "node_id"]
SUMS = {
    "seen": lambda: F.count(F.lit(1)),
    "n_inherits": lambda: F.count_if("inherits"),
    "score": lambda: F.sum("closeness"),
    "lower_bound": lambda: F.sum("lower_bound"),
    "upper_bound": lambda: F.sum("upper_bound"),
}


class Totals:
    """``touched`` rows: star, node_id, wanted (is it of the wanted type, or a target), n_seeds, ``seen_before``, and the ``sums``
    over the seeds that reached the node: seen, and of n_inherits, score, lower_bound and upper_bound those asked for."""

    def __init__(self, ws: Workspace, keys, targets: DataFrame | None = None, wanted_only: bool = False, sums=(), name: str = "totals"):
        self.ws, self.keys, self.targets, self.wanted_only, self.name = ws, list(keys), targets, wanted_only, name
        self.sums = ("seen", *sums)
        self.log: Log | None = None

    def _added(self, fresh: DataFrame, uses: DataFrame) -> DataFrame:
        """What new pairs add to each node of each star that reads their walks."""
        rows = fresh.join(uses, self.keys)
        wanted = F.col("type_id") == F.col("dst_type")
        if self.targets is not None:
            marked = self.targets.select(*NODE).distinct().withColumn("target", F.lit(True))
            rows = rows.join(marked, NODE, "left")
            wanted = F.coalesce("target", F.lit(False))
        rows = rows.withColumn("wanted", wanted)
        if self.wanted_only:
            rows = rows.where("wanted")
        return rows.groupBy(*NODE).agg(
            F.max("wanted").alias("wanted"),
            F.max("n_seeds").alias("n_seeds"),
            *(SUMS[c]().alias(c) for c in self.sums),
        )

    def add(self, hop: int, fresh: DataFrame, uses: DataFrame) -> DataFrame:
        """Log the new pairs of a hop; returns the nodes they touched."""
        added = self._added(fresh, uses)
        if self.log is None:
            touched = added.withColumn("seen_before", F.lit(0).cast("bigint"))
            self.log = Log(self.ws, self.name, touched.schema, NODE)
        else:
            before = self.latest(hop - 1).select(*NODE, *(F.col(c).alias(f"{c}_before") for c in self.sums))
            both = added.join(before, NODE, "left")
            sums = {c: F.col(c) + F.coalesce(f"{c}_before", F.lit(0)) for c in self.sums}
            touched = both.select(*NODE, "wanted", "n_seeds", *(v.alias(c) for c, v in sums.items()), F.coalesce("seen_before", F.lit(0)).cast("bigint").alias("seen_before"))
        self.log.append(touched, hop)
        return self.log.upto(hop, hop).drop("hop")

    def latest(self, hop: int) -> DataFrame:
        """Totals of every node after a hop. Each node is in one bucket, so nothing is shuffled."""
        columns = ["wanted", "n_seeds", *self.sums]
        return self.log.upto(hop).groupBy(*NODE).agg(*(F.max(c).alias(c) for c in columns))

    def close(self) -> None:
        if self.log is not None:
            self.log.close()
