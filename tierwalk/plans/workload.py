"""Workloads and experiments: many queries at once, sweeps over k and graph size."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwalk.operators.batch import Batch
from tierwalk.operators.chain import general_query, join_chain, link_candidates
from tierwalk.operators.graph import Graph, build_graph, graph_fraction, lay_out
from tierwalk.operators.star import STAR, batch_star_query
from tierwalk.params import Domain, ScoreParams
from tierwalk.sources.text import read_edge_list, read_node_info, read_queries
from tierwalk.workspace import Workspace, setting

# Fixed values of the experiments, and the names of their files per graph ratio.
SWEEP_K = (1, 2, 5, 10, 15, 20, 25, 30)
SWEEP_RATIOS = (0.1, 0.2, 0.5, 0.8, 1.0)
EDGE_FILE = "edgeListPart"
NODE_FILE = "nodeInfoPart"


def run_workload(graph: Graph, batch: Batch, domain: Domain, params: ScoreParams) -> DataFrame:
    """Every query of a batch in one run; answers carry query_id."""
    return general_query(graph, batch, domain, params)


def top_k_sweep(
    graph: Graph, batch: Batch, domain: Domain, params: ScoreParams, ks=SWEEP_K
) -> DataFrame:
    """Star answers for several k from one run at the largest.

    Only for exact answers: the thresholds of bound pruning depend on k.
    """
    if params.prune:
        raise ValueError("with pruning the answers for k are no prefix: run each k apart")
    ranked = batch_star_query(graph, batch, domain, params.with_(k=max(ks)))
    fitting = F.filter(F.array(*map(F.lit, sorted(ks))), lambda k: k >= F.col("rank"))
    return ranked.select(F.explode(fitting).alias("k"), "*")


def chain_k_sweep(
    graph: Graph, batch: Batch, domain: Domain, params: ScoreParams, ks=SWEEP_K
) -> DataFrame:
    """General answers for several k. k also limits what each star hands to the chain.

    Star answers at k are the first k of those at the largest, and links at k are those
    between them, so the visits run once; only the chains are joined for each k.
    """
    if params.prune:
        raise ValueError("with pruning the answers for k are no prefix: run each k apart")
    ws = Workspace(graph.spark, "sweep")
    params = params.with_(k=max(ks), star_k=None)
    answers, _ = ws.save(batch_star_query(graph, batch, domain, params), "answers")
    links, _ = ws.save(link_candidates(graph, batch, answers, domain, params), "links")
    runs = []
    for k in ks:
        kept = answers.filter(F.col("rank") <= k)
        ends = kept.select("query_id", "star_id", "node_id")
        sources = ends.withColumnRenamed("node_id", "source_id")
        targets = ends.select("query_id", (F.col("star_id") - 1).alias("star_id"), F.col("node_id").alias("target_id"))
        between = links.join(sources, [*STAR, "source_id"], "left_semi")
        between = between.join(targets, [*STAR, "target_id"], "left_semi")
        rows = join_chain(Workspace(graph.spark, f"sweep-{k}"), batch, kept, between, k)
        runs.append(rows.select(F.lit(k).alias("k"), "*"))
    return reduce(DataFrame.unionByName, runs)


def size_sweep(
    graph: Graph,
    batch: Batch | Callable[[float], Batch],
    domain: Domain,
    params: ScoreParams,
    ratios=SWEEP_RATIOS,
) -> DataFrame:
    """A workload on growing fractions of the graph: one for all, or one per ratio.

    A graph without a nested layout gets one first, which all ratios share. The ratios run side by side: a walk is a row of
    short jobs, most of which cannot keep a cluster busy, and the tasks of one fill the gaps of another."""
    nested = graph if "share" in graph.edges.columns or min(ratios) >= 1 else lay_out(graph, shares=True)

    def run(ratio: float) -> tuple[float, DataFrame]:
        part = graph_fraction(nested, ratio) if ratio < 1 else graph
        queries = batch(ratio) if callable(batch) else batch
        return ratio, run_workload(part, queries, domain, params)

    # They share the session, so they have to agree on what a visit sets.
    shuffles = "spark.sql.shuffle.partitions"
    parts = max(int(graph.spark.conf.get(shuffles)), graph.buckets or 0, nested.buckets or 0)
    with setting(graph.spark, shuffles, str(parts)), ThreadPoolExecutor(len(ratios)) as pool:
        return _by_ratio(list(pool.map(inheritable_thread_target(graph.spark)(run), ratios)))


def _by_ratio(runs: list[tuple[float, DataFrame]]) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        (rows.select(F.lit(float(ratio)).alias("ratio"), "*") for ratio, rows in runs),
    )


def read_ratio(
    spark: SparkSession, graph_prefix: str, query_prefix: str, ratio: float
) -> tuple[Graph, Batch]:
    """Graph and queries of one ratio, from files that carry the ratio in their names."""
    folder = f"{graph_prefix}{ratio}"
    graph = build_graph(
        read_node_info(spark, f"{folder}/{NODE_FILE}{ratio}"),
        read_edge_list(spark, f"{folder}/{EDGE_FILE}{ratio}"),
    )
    return graph, Batch(*read_queries(spark, f"{query_prefix}{ratio}"))


def size_sweep_files(
    spark: SparkSession,
    graph_prefix: str,
    query_prefix: str,
    domain: Domain,
    params: ScoreParams,
    ratios=SWEEP_RATIOS,
) -> DataFrame:
    """The workload of each ratio on the graph of that ratio, all read from files."""
    runs = []
    for ratio in ratios:
        graph, batch = read_ratio(spark, graph_prefix, query_prefix, ratio)
        runs.append((ratio, run_workload(lay_out(graph), batch, domain, params)))
    return _by_ratio(runs)
