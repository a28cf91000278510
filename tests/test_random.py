"""Random graphs against brute force. Many small graphs live in one graph with disjoint
ids and are asked in one batch, which also checks that queries do not mix."""

import random
from collections import defaultdict

import pytest
from brute import BruteGraph

from tierwalk import ScoreParams, batch_star_query, build_graph, chain_batch, general_query, lay_out
from tierwalk.params import SYNTHETIC
from tierwalk.plans.workload import size_sweep

N_GRAPHS, SPAN = 40, 1000


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(7)
    types, edges, chains = {}, {}, {}
    for g in range(N_GRAPHS):
        ids = [g * SPAN + i for i in range(rng.randint(6, 22))]
        types.update((n, rng.choice([0, 0, 0, 1, 2, 4])) for n in ids)
        for _ in range(len(ids) * rng.choice([2, 3, 4])):
            src, dst = rng.sample(ids, 2)
            edges[src, dst] = rng.choice([-1, 0, 0, 1])
        hub = ids[0]
        edges.update({(hub, n): 0 for n in ids[1:] if rng.random() < 0.5})

        def star(size):
            return [(n, types[n]) for n in rng.sample(ids, size)], rng.choice([0, 0, 1])

        chains[g] = [star(rng.randint(1, 3)) for _ in range(rng.randint(1, 3))]
    # Two queries that ask for the same seeds share walks.
    chains[N_GRAPHS] = chains[0]
    nodes = spark.createDataFrame(list(types.items()), "node_id long, type_id int")
    arcs = spark.createDataFrame([(s, d, v) for (s, d), v in edges.items()], "src long, dst long, level int")
    graph = lay_out(build_graph(nodes, arcs), buckets=2, piece_rows=6)
    return graph, BruteGraph(types, edges), chains, chain_batch(spark, chains)


def star_results(graph, batch, params):
    got = defaultdict(list)
    for r in batch_star_query(graph, batch, SYNTHETIC, params).orderBy("rank").collect():
        got[r.query_id, r.star_id].append((r.node_id, round(r.score, 7)))
    return got


@pytest.mark.parametrize(
    "options, k",
    [
        ({}, 2),
        ({"early_stop": True}, 2),
        ({"max_hops": 2}, 5),
        ({"prune": "bound", "max_hops": 4}, 2),
        ({"stop": "coverage", "max_hops": 4}, 3),
        ({"stop": "coverage", "max_hops": 3, "small": 300}, 3),
        ({"prune": "bound", "max_hops": 3, "small": -1}, 2),
    ],
)
def test_stars(world, options, k, monkeypatch):
    options = dict(options)
    if "small" in options:  # state in buckets, from some hop on or from the start
        monkeypatch.setattr("tierwalk.workspace.SMALL", options.pop("small"))
    graph, brute, chains, batch = world
    got = star_results(graph, batch, ScoreParams(k=k, **options))
    exact = {key: value for key, value in options.items() if key != "early_stop"}
    for query_id, chain in chains.items():
        for star_id, (seeds, dst_type) in enumerate(chain):
            want = [(n, round(s, 7)) for n, s in brute.star(seeds, dst_type, k=k, **exact)]
            assert got[query_id, star_id] == want, (query_id, star_id)


@pytest.mark.parametrize("options", [{}, {"prune": "bound"}, {"stop": "coverage"}])
def test_chains(world, options):
    graph, brute, chains, batch = world
    k, options = 3, {"max_hops": 4, **options}
    got = defaultdict(list)
    rows = general_query(graph, batch, SYNTHETIC, ScoreParams(k=k, star_k=4, **options))
    for r in rows.orderBy("rank").collect():
        got[r.query_id].append((r.node_ids, round(r.score, 7)))
    for query_id, chain in chains.items():
        want = [(ids, round(s, 7)) for ids, s in brute.chain(chain, k=k, star_k=4, **options)]
        assert got[query_id] == want, query_id


def test_large_frontier_joins_without_broadcast(world, monkeypatch, spark):
    graph, brute, chains, batch = world
    monkeypatch.setattr("tierwalk.operators.visit.BROADCAST_ROWS", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = star_results(graph, batch, ScoreParams(k=4, max_hops=3))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    for query_id, chain in chains.items():
        seeds, dst_type = chain[0]
        want = [(n, round(s, 7)) for n, s in brute.star(seeds, dst_type, k=4, max_hops=3)]
        assert got[query_id, 0] == want


def test_size_sweep(world, spark):
    graph, _, _, batch = world
    params = ScoreParams(k=2, max_hops=1)
    both = size_sweep(graph, batch, SYNTHETIC, params, ratios=(0.5, 1.0))
    assert {r.ratio for r in both.select("ratio").distinct().collect()} == {0.5, 1.0}


def test_missing_seed_and_empty_batch(world, spark):
    graph = world[0]
    # Unknown seed: nothing is reached from every seed.
    lost = chain_batch(spark, {1: [([(0, 0), (-5, 0)], 0)]})
    assert batch_star_query(graph, lost, SYNTHETIC, ScoreParams(max_hops=2)).count() == 0
    assert general_query(graph, chain_batch(spark, {}), SYNTHETIC, ScoreParams()).count() == 0


def test_parameters():
    for bad in ({"k": 0}, {"stop": "x"}, {"prune": "x"}, {"prune": "bound", "early_stop": True}):
        with pytest.raises(ValueError):
            ScoreParams(**bad)
