"""Rules that must not change answers, query graphs that must be refused, and queries that must be able to fail."""

import pytest
from compare import connect

from suite import oracle as o
from suite import queries as q
from tierwalk import (
    ScoreParams,
    batch_star_query,
    build_graph,
    chain_batch,
    close_graph,
    general_query,
    lay_out,
    link_candidates,
    open_graph,
    remove_edges,
    star_batch,
    star_visit,
)
from tierwalk.operators import chain as chains
from tierwalk.operators import visit as visits
from tierwalk.operators.chain import keep_leading
from tierwalk.params import SYNTHETIC
from tierwalk.plans.decompose import decompose_query
from tierwalk.sources import read_queries


def graph_from(spark, types, edges):
    both = edges + [(d, s, -v) for s, d, v in edges]
    nodes = spark.createDataFrame(list(types.items()), "node_id long, type_id int")
    return build_graph(nodes, spark.createDataFrame(both, "src long, dst long, level int"))


def answers(graph, seeds, params, k=None):
    rows = batch_star_query(graph, star_batch(graph.spark, seeds, 0), SYNTHETIC, params, k)
    return [(r.rank, r.node_id, round(r.score, 7)) for r in rows.orderBy("rank").collect()]


@pytest.fixture(scope="module")
def path(spark):
    """A seed with answers at distances one to four."""
    return graph_from(spark, {1: 2, 10: 0, 11: 0, 12: 0, 13: 0}, [(1, 10, 0), (10, 11, 0), (11, 12, 0), (12, 13, 0)])


def test_k_of_the_call_rules_the_early_stop(path):
    params = ScoreParams(k=1)
    assert answers(path, [(1, 2)], params.with_(early_stop=True), k=3) == answers(path, [(1, 2)], params, k=3)
    assert len(answers(path, [(1, 2)], params.with_(early_stop=True), k=3)) == 3


def test_path_counts_have_no_cap(spark):
    """Eighty layers of two nodes: 2 ** 80 shortest paths."""
    layers = [[100 * n, 100 * n + 1] for n in range(1, 81)]
    edges = [(1, n, 0) for n in layers[0]] + [(a, b, 0) for x, y in zip(layers, layers[1:]) for a in x for b in y]
    types = {n: 0 for layer in layers for n in layer} | {1: 4, 2: 0}
    graph = graph_from(spark, types, [*edges, *((n, 2, 0) for n in layers[11])])
    visit = star_visit(graph, star_batch(spark, [(1, 4)], 0), SYNTHETIC, ScoreParams(max_hops=13))
    counts = {r.node_id: r.n_paths for r in visit.state.collect()}
    assert counts[1200] == 2.0**11 and counts[2] == 2.0**12
    assert visit.state.schema["n_paths"].dataType.simpleString() == "double"


@pytest.mark.parametrize("bad", [{"alpha": 1.0}, {"alpha": 0.0}, {"beta": 1.5}, {"beta": -0.1}, {"max_hops": -1}])
def test_values_that_void_the_caps(bad):
    with pytest.raises(ValueError):
        ScoreParams(**bad)


def test_removed_edges_with_a_large_frontier(spark, monkeypatch):
    types = {n: n % 3 for n in range(1, 40)}
    edges = [(a, b, 0) for a in types for b in types if a < b and (a * b) % 5 == 1]
    gone = edges[::4]
    pairs = spark.createDataFrame(gone + [(d, s, v) for s, d, v in gone], "src long, dst long, level int")
    left = graph_from(spark, types, [e for e in edges if e not in gone])
    laid = lay_out(graph_from(spark, types, edges), buckets=3)
    want = answers(left, [(1, 1), (2, 2)], ScoreParams(k=10))
    assert remove_edges(laid, pairs).buckets == laid.buckets
    assert answers(remove_edges(laid, pairs), [(1, 1), (2, 2)], ScoreParams(k=10)) == want
    monkeypatch.setattr(visits, "BROADCAST_ROWS", 0)
    assert answers(remove_edges(laid, pairs), [(1, 1), (2, 2)], ScoreParams(k=10)) == want


UNKNOWN, NEXT = "query_id long, unknown_id int, dst_type int", "query_id long, unknown_id int, next_id int"
KNOWN = "query_id long, unknown_id int, seed_id long, seed_type int"


@pytest.mark.parametrize(
    "unknowns, edges",
    [
        ([1, 2], [(1, 2), (2, 1)]),  # a cycle
        ([1, 2, 3], [(1, 2), (1, 3)]),  # a branch
        ([1, 2, 3], [(1, 3), (2, 3)]),  # a join
        ([1, 2], []),  # two heads
        ([1, 2, 3, 4], [(1, 2), (3, 4), (4, 3)]),  # a chain and a cycle
        ([1], [(1, 2)]),  # an edge to no unknown
        ([1, 1], []),  # an unknown twice
    ],
)
def test_query_graphs_that_are_no_chain(spark, unknowns, edges):
    frame = spark.createDataFrame([(1, 9, 0)] + [(7, u, 0) for u in unknowns], UNKNOWN)
    known = spark.createDataFrame([(7, 1, 5, 2)], KNOWN)
    with pytest.raises(ValueError, match="query 7"):
        decompose_query(frame, known, spark.createDataFrame([(7, *e) for e in edges], NEXT))


def test_query_ids_are_places_in_the_file(spark, tmp_path):
    lines = [f"{n},2;0" if n % 3 else "" for n in range(2000)]
    (tmp_path / "q").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4000)
    try:
        seeds, _ = read_queries(spark, str(tmp_path / "q"))
        got = [(r.query_id, r.seed_id) for r in seeds.orderBy("query_id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate(n for n in range(2000) if n % 3))


def test_ties_keep_k_tuples_per_end(spark):
    rows = [(1, b, [a, b], 1.5) for a in range(30) for b in range(30)]
    tuples = spark.createDataFrame(rows, "query_id long, last_id long, node_ids array<long>, score double")
    kept = keep_leading(tuples, 5).collect()
    assert len(kept) == 150 and max(r.node_ids[0] for r in kept) == 4


def test_links_end_when_all_pairs_are_reached(spark):
    """A tail of a hundred nodes behind the targets is not walked."""
    types = {1: 2, 2: 2, 10: 0, 11: 0} | {n: 4 for n in range(100, 200)}
    edges = [(1, 10, 0), (2, 11, 0), (10, 11, 0), (11, 100, 0)] + [(n, n + 1, 0) for n in range(100, 199)]
    graph = graph_from(spark, types, edges)
    batch = chain_batch(spark, {1: [([(1, 2)], 0), ([(2, 2)], 0)]})
    from tierwalk.operators.chain import link_visit

    found = batch_star_query(graph, batch, SYNTHETIC, ScoreParams(k=2, max_hops=3))
    visit, _ = link_visit(graph, batch, found, SYNTHETIC, ScoreParams(k=2))
    assert len(visit.hops) < 5
    rows = general_query(graph, batch, SYNTHETIC, ScoreParams(k=4, max_hops=3)).collect()
    unbounded = general_query(graph, batch, SYNTHETIC, ScoreParams(k=4)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, unbounded))


@pytest.mark.parametrize("piece_rows", [None, 2])
def test_a_layout_can_be_opened_again(spark, path, tmp_path, piece_rows):
    folder = str(tmp_path / "graph")
    laid = lay_out(path, buckets=3, piece_rows=piece_rows, path=folder)
    want = answers(laid, [(1, 2)], ScoreParams(k=4))
    close_graph(laid)
    again = open_graph(spark, folder)
    assert again.buckets == 3 and (again.hubs is None) == (laid.hubs is None)
    assert answers(again, [(1, 2)], ScoreParams(k=4)) == want
    assert answers(path, [(1, 2)], ScoreParams(k=4)) == want
    close_graph(again)
    assert not [t for t in spark.catalog.listTables() if t.name == again.table]


FOLDER = "/root/testdata/sf0.01"
OPTIONS = {
    "star_visit_coverage": (o.star_sql(q.THREE, 8, q.K, f"SELECT {o.VISIT_COLUMNS} FROM visit")),
    "star_visit_pruned": (o.star_sql(q.THREE, q.HOPS, q.K, f"SELECT {o.VISIT_COLUMNS} FROM visit")),
    "link_visit_coverage": q._link_visit_sql(8),
    "link_candidates_pruned_deep": q._links_sql(4),
    "chain_two_star_k": o.chain_sql(q.DEEP, q.HOPS, q.K),
    "star_query_removed_edges": q._star_answers_sql(),
}


@pytest.mark.parametrize("name", OPTIONS)
def test_queries_differ_from_the_plain_ones(name):
    con = connect(FOLDER)
    assert sorted(con.execute(q.ORACLE[name]).fetchall()) != sorted(con.execute(OPTIONS[name]).fetchall())


def test_every_leg_of_the_size_sweep_has_rows():
    rows = connect(FOLDER).execute(f"SELECT ratio, COUNT(*) FROM ({q.ORACLE['size_sweep']}) GROUP BY ratio").fetchall()
    assert len(rows) == 5 and all(n for _, n in rows)


def test_seeds_are_picked_without_a_layout(spark):
    folder = "/root/testdata/sf0.001/"
    rows = q.QUERIES["pick_seeds"](spark, folder).collect()
    assert (spark.sparkContext.applicationId, folder) not in q._GRAPHS
    want = connect(folder).execute(q.ORACLE["pick_seeds"]).fetchall()
    assert sorted(map(tuple, rows)) == sorted(want) and want


@pytest.mark.parametrize("max_hops", [None, 4])
def test_stars_asked_for_answers_end_by_themselves(spark, path, max_hops):
    params, batch = ScoreParams(k=1, max_hops=max_hops), star_batch(spark, [(1, 4)], 0)
    graph = lay_out(path)
    full = star_visit(graph, batch, SYNTHETIC, params)
    short = star_visit(graph, batch, SYNTHETIC, params, answers_only=True)
    assert len(full.hops) >= 5 and len(short.hops) == 3
    assert answers(graph, [(1, 4)], params) == answers(path, [(1, 4)], params) == [(1, 10, 0.9)]
    close_graph(graph)


@pytest.fixture(scope="module")
def fan(spark):
    """From 1 two hops to 3, and two hops to each of the fan 51 to 59, from where the walk could go on."""
    wide = [(50, n, 0) for n in range(51, 60)] + [(n, n + 100, 0) for n in range(51, 60)]
    types = {n: 4 for e in wide for n in e[:2]} | {1: 0, 2: 4, 3: 1}
    return graph_from(spark, types, [(1, 2, 0), (2, 3, 0), (1, 50, 0), *wide])


def _one_link(spark):
    rows = [(1, 0, 1, 1, 0, 0.9), (1, 1, 1, 3, 1, 0.9)]
    found = spark.createDataFrame(rows, "query_id long, star_id int, rank int, node_id long, type_id int, score double")
    return chain_batch(spark, {1: [([(1, 4)], 0), ([(3, 4)], 1)]}), found


@pytest.mark.parametrize("prune", [None, "bound"])
def test_links_walk_towards_their_targets(spark, fan, prune):
    batch, found = _one_link(spark)
    visit, _ = chains.link_visit(fan, batch, found, SYNTHETIC, ScoreParams(max_hops=3, prune=prune))
    assert {r.node_id for r in visit.state.collect()} == {1, 2, 50, 3}
    assert visit.linked


@pytest.mark.parametrize("prune", [None, "bound"])
def test_unbounded_links_try_short_bounds_first(spark, fan, monkeypatch, prune):
    batch, found = _one_link(spark)
    bounds, walk = [], chains.link_visit

    def watched(graph, batch, answers, domain, params):
        bounds.append(params.max_hops)
        return walk(graph, batch, answers, domain, params)

    monkeypatch.setattr(chains, "link_visit", watched)
    rows = link_candidates(fan, batch, found, SYNTHETIC, ScoreParams(prune=prune)).collect()
    assert [(r.source_id, r.target_id, round(r.closeness, 6)) for r in rows] == [(1, 3, 0.81)]
    assert bounds == [3]


def test_links_without_a_way_end(spark, monkeypatch):
    """No short bound reaches the target: the walk goes on as far as it may."""
    graph = graph_from(spark, {1: 0, 2: 4, 3: 1}, [(1, 2, 0)])
    batch, found = _one_link(spark)
    assert link_candidates(graph, batch, found, SYNTHETIC, ScoreParams()).collect() == []
