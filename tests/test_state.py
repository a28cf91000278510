"""State kept in buckets, two-sided search, nested fractions, and files in order."""

import random
from collections import deque

import pytest

from brute import BruteGraph
from pyspark.sql import functions as F

from tierwalk import (
    ScoreParams,
    batch_star_query,
    build_graph,
    chain_batch,
    graph_fraction,
    lay_out,
    lookup_nodes,
    open_graph,
    remove_edges,
    shortest_path,
    star_visit,
)
from tierwalk.operators import paths, visit
from tierwalk.operators.graph import close_graph, with_names
from tierwalk.operators.stopping import check_levels
from tierwalk.params import SYNTHETIC
from tierwalk.sources import read_queries
from tierwalk.workspace import Log, Workspace


def graph_from(spark, types, edges, **layout):
    nodes = spark.createDataFrame(list(types.items()), "node_id long, type_id int")
    arcs = spark.createDataFrame([(s, d, v) for (s, d), v in edges.items()], "src long, dst long, level int")
    return lay_out(build_graph(nodes, arcs), **layout)


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = random.Random(3)
    types = {n: rng.choice([0, 1, 2, 4]) for n in range(60)}
    edges = {tuple(rng.sample(range(60), 2)): rng.choice([-1, 0, 1]) for _ in range(110)}
    return types, edges, graph_from(spark, types, edges, buckets=2, piece_rows=4)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("small", [-1, 10])
def test_visited_pairs_are_not_shuffled(spark, random_graph, monkeypatch, small):
    """With broadcasts off, the only exchange on (walk, node) is the reduce of the hop itself, from the start or once the state is large."""
    graph = random_graph[2]
    monkeypatch.setattr("tierwalk.workspace.SMALL", small)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ws = Workspace(spark, "test")
        uses = visit.star_uses(chain_batch(spark, {1: [([(1, 2), (2, 2)], 0)]}), SYNTHETIC, ScoreParams())
        start = visit.init_frontier(uses, graph, visit.SHARED, [])
        log = Log(ws, "state", start.schema, [*visit.SHARED, "node_id"], "dist")
        for hop in range(5):
            fresh = start if not hop else visit.propagate(log.upto(hop - 1, hop - 1), 9, 2, log.upto(hop - 1), graph, visit.SHARED, hop, ScoreParams())
            if hop == 4:
                text = plan(fresh)
                assert text.count("Exchange hashpartitioning(seed_id") == 1 and "LeftAnti" in text
                assert "Bucketed: true" in text.split("LeftAnti")[1]
            log.append(fresh, hop)
        rows = log.rows().count()
        assert rows == log.total == log.rows().select(*visit.SHARED, "node_id").distinct().count() > 10
        log.close()
        assert log.rows().count() == rows and not spark.catalog.tableExists(log.table)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_catalog_entry_is_left(spark, random_graph):
    before = {t.name for t in spark.catalog.listTables()}
    for changes in ({}, {"stop": "coverage"}, {"early_stop": True}, {"prune": "bound"}):
        star_visit(random_graph[2], chain_batch(spark, {1: [([(1, 2), (2, 2)], 0)]}), SYNTHETIC, ScoreParams(k=1, max_hops=2).with_(**changes))
    shortest_path(random_graph[2], 1, 2)
    assert {t.name for t in spark.catalog.listTables()} == before


def brute_path(edges, src, dst, hops=None):
    """The shortest path with the smallest ids from its end."""
    dist, queue = {src: 0}, deque([src])
    while queue:
        u = queue.popleft()
        for a, b in edges:
            if a == u and b not in dist and (hops is None or dist[u] < hops):
                dist[b] = dist[u] + 1
                queue.append(b)
    if dst not in dist:
        return []
    path = [dst]
    while path[0] != src:
        path.insert(0, min(a for a, b in edges if b == path[0] and dist.get(a) == dist[path[0]] - 1))
    return path


def test_shortest_paths(spark, random_graph):
    _, edges, graph = random_graph
    rng = random.Random(1)
    pairs = [(*rng.sample(range(60), 2), None) for _ in range(5)] + [(5, 5, None), (5, 999, None), (*next(iter(edges)), 1)]
    pairs += [(s, d, len(p) - 2) for s, d, _ in pairs[:5] if len(p := brute_path(edges, s, d)) > 2][:1]
    for src, dst, hops in pairs:
        got = shortest_path(graph, src, dst, max_hops=hops).collect()
        want = [src] if src == dst else brute_path(edges, src, dst, hops)
        assert [tuple(r) for r in got] == [(src, dst, want)]


def test_the_smaller_frontier_grows(spark):
    """A source in a crowd and a target at the end of a lane: the crowd's neighbours are never visited."""
    edges = {(0, 1): 0, (1, 2): 0, (2, 3): 0, (3, 4): 0}
    edges.update({(1, 100 + n): 0 for n in range(200)})
    edges.update({(100 + n, 1000 + n): 0 for n in range(200)})
    graph = graph_from(spark, dict.fromkeys(range(5), 0), edges, buckets=2)
    search = paths.TwoSided(Workspace(spark, "test"), graph, 0, 4)
    try:
        assert search.run() and search.visited < 210
        assert search.path().first()["path"] == [0, 1, 2, 3, 4]
    finally:
        search.close()


def test_nested_layout(spark, random_graph, tmp_path):
    types, edges, plain = random_graph
    nested = graph_from(spark, types, edges, buckets=2, shares=True, path=str(tmp_path / "nested"))
    for graph in (nested, open_graph(spark, str(tmp_path / "nested"))):
        for ratio in (0.2, 0.5, 0.8):
            a, b = graph_fraction(graph, ratio), graph_fraction(plain, ratio)
            for x, y in ((a.edges, b.edges), (a.nodes, b.nodes)):
                columns = [c for c in y.columns if c not in ("slot", "share")]
                assert sorted(map(tuple, x.select(*columns).collect())) == sorted(map(tuple, y.select(*columns).collect()))
        text = plan(graph_fraction(graph, 0.2).edges.select("src", "dst"))
        assert "LessThan(share" in text and "md5" not in text and "Bucketed" in text


def splits(spark, df):
    """How many pieces of files a scan reads."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    try:
        return df.select("*")._jdf.queryExecution().toRdd().getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_look_ups_read_their_buckets(spark, random_graph):
    types, edges, _ = random_graph
    graph = graph_from(spark, types, edges, buckets=16)
    ids = spark.createDataFrame([(3,), (4,), (3,), (999,)], "node_id long")
    for found in (lookup_nodes(graph, [3, 4]), lookup_nodes(graph, ids)):
        assert sorted(r["node_id"] for r in found.collect()) == [3, 4]
        assert "In(node_id, [" in plan(found)
    assert splits(spark, lookup_nodes(graph, [3, 4])) <= splits(spark, graph.nodes) / 4
    names = with_names(ids.distinct(), graph, rows=3)
    assert sorted(r["node_id"] for r in names.collect()) == [3, 4] and "In(node_id, [" in plan(names)
    close_graph(graph)


def test_removed_edges_leave_the_buckets(spark, random_graph):
    types, edges, graph = random_graph
    rng = random.Random(5)
    gone = rng.sample(sorted(edges), 30)
    first, second = (spark.createDataFrame(some, "src long, dst long") for some in (gone[:20], gone[15:] + [(777, 1)]))
    less = remove_edges(remove_edges(graph, first), second)
    left = {e: v for e, v in edges.items() if e not in gone}
    assert {(r["src"], r["dst"]) for r in less.edges.collect()} == set(left)
    assert less.buckets == graph.buckets and less.hubs is graph.hubs
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(visit.meet_edges(spark.createDataFrame([(n,) for n in range(9)], "node long"), 10**7, 10**7, less))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in text and text.count("Exchange hashpartitioning(slot") == 0
    seeds = [(n, types[n]) for n in rng.sample(range(60), 2)]
    for some in (less, graph_fraction(less, 0.9)):
        kept = {r["node_id"] for r in some.nodes.collect()}
        brute = BruteGraph({n: t for n, t in types.items() if n in kept}, {e: v for e, v in left.items() if kept.issuperset(e)})
        got = batch_star_query(some, chain_batch(spark, {1: [(seeds, 0)]}), SYNTHETIC, ScoreParams(k=9, max_hops=4))
        assert [(r["node_id"], round(r["score"], 7)) for r in got.orderBy("rank").collect()] == [(n, round(s, 7)) for n, s in brute.star(seeds, 0, k=9, max_hops=4)]


def test_levels_are_known(spark, tmp_path):
    graph = graph_from(spark, {1: 0, 2: 0}, {(1, 2): 3}, path=str(tmp_path / "odd"))
    assert graph.odd_levels == 1 and open_graph(spark, str(tmp_path / "odd")).odd_levels == 1
    with pytest.raises(ValueError):
        check_levels(graph)


def test_query_files_in_order(spark, tmp_path):
    """Splits of large files come first in a scan; ids go by file and line all the same."""
    folder = tmp_path / "queries"
    folder.mkdir()
    sizes = {"a.txt": 3, "b.txt": 40, "c.txt": 1}
    for name, n in sizes.items():
        (folder / name).write_text("\n".join(f"{ord(name[0]) * 1000 + i},1;0" for i in range(n)) + "\n\n")
    want = [ord(name[0]) * 1000 + i for name, n in sizes.items() for i in range(n)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "64b"):  # files as a whole, and in many splits
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            seeds, _ = read_queries(spark, str(folder))
            assert [r["seed_id"] for r in seeds.orderBy("query_id").collect()] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_many_walks_on_one_node(spark, monkeypatch):
    """A thousand walks through one node: its edges go to them, and they are not brought into one task."""
    walks = range(1000, 2000)
    types = {n: 2 for n in walks} | {n: 1 for n in (1, 2, 3)} | {n: 0 for n in range(10, 40)}
    edges = {(n, 1 + n % 2): n % 3 - 1 for n in walks} | {(1, n): 1 for n in range(10, 40)} | {(2, 3): 0, (3, 10): -1}
    graph = graph_from(spark, types, edges, buckets=8)
    batch = chain_batch(spark, {n: [([(n, 2)], 0)] for n in walks})
    params = ScoreParams(max_hops=3)
    columns = ("seed_id", "inherits", "node_id", "n_paths", "hier", "closeness", "lower_bound", "parent_id", "dist")

    def state():
        return sorted(map(tuple, star_visit(graph, batch, SYNTHETIC, params).state.select(*columns).collect()))

    want = state()
    monkeypatch.setattr(visit, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(visit, "HOT_WALKS", 200)
    uses = visit.star_uses(batch, SYNTHETIC, params)
    start = visit.init_frontier(uses, graph, visit.SHARED, [])
    steps = visit.propagate(start, 1000, 1000, start, graph, visit.SHARED, 1, params).withColumnRenamed("node_id", "node")
    hot, arcs = visit.hot_nodes(steps, graph)
    assert hot == [1, 2] and sorted(r["src"] for r in arcs.collect()) == [1] * len(edges_of(edges, 1)) + [2] * len(edges_of(edges, 2))
    spread = steps.repartition(8).select(*visit.SHARED, "node", "n_paths", "hier", "lower_bound")
    met = visit.meet(spread, 1000, 1000, graph)
    tasks = met.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) >= 8 and "BroadcastHashJoin" in plan(met)
    assert met.count() == spread.join(graph.edges, F.col("node") == F.col("src")).count()
    assert state() == want
    monkeypatch.setattr(visit, "HOT_EDGES", len(edges_of(edges, 2)))
    assert set(visit.hot_nodes(steps, graph)[0]) <= {1, 2} and state() == want
    monkeypatch.setattr(visit, "HOT_EDGES", 0)
    assert visit.hot_nodes(steps, graph) == ([], None) and state() == want


def edges_of(edges, node):
    """Edges out of a node."""
    return {(s, d) for s, d in edges if s == node}


@pytest.mark.parametrize("prune", [None, "bound"])
def test_filled_types_get_no_messages(spark, monkeypatch, prune):
    """Once a walk has every node of a type, nothing is sent there, and what it finds stays the same."""
    types = {0: 2, **{n: 0 for n in range(1, 6)}, **{n: 1 for n in range(6, 12)}, 12: 2}
    edges = {(a, b): 0 for n in range(1, 6) for a, b in [(0, n), (n, 0), (n, n + 5), (n + 5, n), (n, n + 6), (12, n + 6)]}
    graph = graph_from(spark, types, edges, buckets=2)
    batch = chain_batch(spark, {1: [([(0, 2), (12, 2)], 0)]})
    params = ScoreParams(max_hops=None, prune=prune)

    def rows():
        found = star_visit(graph, batch, SYNTHETIC, params)
        return sorted(map(str, found.state.select(*sorted(found.state.columns)).collect())), found.hops

    want, known, after = rows(), [], visit.Filled.after

    def watching(self, hop, log):
        full = after(self, hop, log)
        known.append([] if full is None else sorted((r["seed_id"], r["dst_type"]) for r in full.collect()))
        return full

    for module in ("workspace", "operators.filled"):
        monkeypatch.setattr(f"tierwalk.{module}.SMALL", -1)
    monkeypatch.setattr(visit.Filled, "after", watching)
    assert rows() == want
    assert known[:2] == [[], [(0, 0)]]


def test_reduces_are_dealt_like_the_edges(spark, random_graph, monkeypatch):
    """A larger graph has more buckets, and its walk as many partitions and buckets of state."""
    types, edges, _ = random_graph
    parts = []
    append = Log.append

    def watching(self, *args, **counted):
        parts.append((self.buckets, spark.conf.get("spark.sql.shuffle.partitions")))
        return append(self, *args, **counted)

    monkeypatch.setattr(Log, "append", watching)
    star_visit(graph_from(spark, types, edges, buckets=5), chain_batch(spark, {1: [([(1, 2)], 0)]}), SYNTHETIC, ScoreParams())
    assert set(parts) == {(5, "5")} and spark.conf.get("spark.sql.shuffle.partitions") == "2"
