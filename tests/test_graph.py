"""Graph assembly, layout and graph operators."""

import pytest

from tierwalk import (
    build_graph,
    build_property_graph,
    chain_batch,
    graph_fraction,
    graph_stats,
    lay_out,
    lookup_nodes,
    preview,
    remove_edges,
    triplets,
    with_names,
    with_type_names,
)
from tierwalk.operators.graph import dedup_edges
from tierwalk.params import BIBLIOGRAPHY, PRODUCT
from tierwalk.plans.decompose import decompose_query


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def literal(spark):
    """The typed graph of four nodes, with one edge to a node nobody declared."""
    nodes = spark.createDataFrame([(3, 1), (7, 3), (5, 2), (2, 3)], "node_id long, type_id int")
    edges = spark.createDataFrame(
        [(3, 7, 1), (5, 3, -1), (2, 5, 0), (5, 7, 1), (7, 99, 0)], "src long, dst long, level int"
    )
    return build_graph(nodes, edges)


def test_build(spark, literal):
    assert tuples(graph_stats(literal)) == [(5, 1, 5)]
    assert tuples(literal.nodes.filter("implicit").select("node_id", "type_id")) == [(99, 0)]
    assert tuples(literal.edges) == [(2, 5, 0, 2), (3, 7, 1, 3), (5, 3, -1, 1), (5, 7, 1, 3), (7, 99, 0, 0)]
    other = build_graph(literal.nodes.limit(0), literal.edges, default_type=6)
    assert other.nodes.filter("type_id <> 6 OR NOT implicit").count() == 0


def test_parallel_edges(spark):
    nodes = spark.createDataFrame([(1, 0), (2, 0), (1, 5)], "node_id long, type_id int")
    edges = spark.createDataFrame([(1, 2, 0), (1, 2, -1), (1, 2, 1), (2, 1, -1), (2, 1, 0)], "src long, dst long, level int")
    graph = build_graph(nodes, edges)
    assert tuples(graph.edges) == [(1, 2, 1, 0), (2, 1, -1, 0)]
    assert graph.nodes.count() == 2


def test_triplets_and_filters(spark, literal):
    got = triplets(literal).select("src", "src_type", "level", "dst", "dst_type")
    assert tuples(got)[0] == (2, 3, 0, 5, 2)
    assert got.count() == 5 and preview(got).count() == 5
    assert tuples(lookup_nodes(literal, [3, 7]).select("node_id")) == [(3,), (7,)]
    asked = spark.createDataFrame([(3,), (3,), (8,)], "node_id long")
    assert tuples(lookup_nodes(literal, asked).select("node_id")) == [(3,)]
    cut = remove_edges(literal, spark.createDataFrame([(3, 7), (3, 5)], "src long, dst long"))
    # The reverse of a listed pair stays.
    assert tuples(cut.edges.select("src", "dst")) == [(2, 5), (5, 3), (5, 7), (7, 99)]


def test_names(spark, literal):
    named = with_type_names(literal.nodes, PRODUCT)
    assert {r.node_id: r.type_name for r in named.collect()}[3] == "VULNERABILITY"
    assert BIBLIOGRAPHY.type_id("WWW") == 12
    answers = spark.createDataFrame([(3,), (99,)], "node_id long")
    assert tuples(with_names(answers, literal).select("node_id")) == [(3,)]


def test_layout_keeps_edges_and_cuts_hubs(spark):
    nodes = spark.createDataFrame([(i, 0) for i in range(301)], "node_id long, type_id int")
    star = [(0, i, 0) for i in range(1, 301)] + [(i, 0, 0) for i in range(1, 301)]
    plain = build_graph(nodes, spark.createDataFrame(star, "src long, dst long, level int"))
    laid = lay_out(plain, buckets=8, piece_rows=20)
    assert tuples(laid.hubs) == [(0, 15)]
    assert tuples(laid.edges.drop("slot")) == tuples(plain.edges)
    sizes = [r["count"] for r in laid.edges.filter("src = 0").groupBy("slot").count().collect()]
    assert len(sizes) == 15 and max(sizes) < 60
    assert lay_out(plain, buckets=4).hubs is None


def test_fraction(spark, literal):
    nodes = spark.range(2000).selectExpr("id AS node_id", "0 AS type_id")
    edges = spark.range(2000).selectExpr("id AS src", "(id + 1) % 2000 AS dst", "0 AS level")
    graph = build_graph(nodes, edges)
    small, large = graph_fraction(graph, 0.2), graph_fraction(graph, 0.6)
    ids = {r.node_id for r in small.nodes.collect()}
    assert 250 < len(ids) < 550
    assert ids <= {r.node_id for r in large.nodes.collect()}
    assert all(r.src in ids and r.dst in ids for r in small.edges.collect())
    assert graph_fraction(graph, 1.0).edges.count() == 2000
    assert {r.node_id for r in lay_out(small).nodes.collect()} == ids


def test_layout_completes_nodes(literal):
    laid = lay_out(literal, buckets=2)
    assert tuples(laid.nodes.select("node_id", "type_id", "implicit")) == tuples(
        literal.nodes.select("node_id", "type_id", "implicit")
    )
    assert tuples(laid.edges) == tuples(literal.edges)


def test_property_graph(spark):
    people = [(key, f"person {key}", 30) for key in "abcdefg"]
    links = [(src, dst, "knows") for src, dst in ("ab", "bc", "cb", "fc", "ef", "ed", "da", "ae")]
    vertices, edges = build_property_graph(
        spark.createDataFrame(people, "id string, name string, age int"),
        spark.createDataFrame(links, "src string, dst string, relationship string"),
    )
    assert {r.id: r.node_id for r in vertices.collect()} == dict(zip("abcdefg", range(1, 8)))
    assert ("e", "d", "knows", 5, 4) in tuples(edges.select("src", "dst", "relationship", "src_id", "dst_id"))
    assert edges.count() == 8


def test_decompose(spark):
    unknowns = spark.createDataFrame(
        [(1, 30, 0), (1, 10, 3), (1, 20, 1), (2, 5, 0)], "query_id long, unknown_id int, dst_type int"
    )
    known = spark.createDataFrame(
        [(1, 30, 7, 2), (1, 10, 8, 2), (1, 20, 9, 2), (1, 20, 6, 1), (2, 5, 4, 1)],
        "query_id long, unknown_id int, seed_id long, seed_type int",
    )
    chain = spark.createDataFrame([(1, 30, 10), (1, 10, 20)], "query_id long, unknown_id int, next_id int")
    got = decompose_query(unknowns, known, chain)
    want = chain_batch(
        spark, {1: [([(7, 2)], 0), ([(8, 2)], 3), ([(9, 2), (6, 1)], 1)], 2: [([(4, 1)], 0)]}
    )
    assert tuples(got.seeds) == tuples(want.seeds)
    assert tuples(got.stars) == tuples(want.stars)


def test_parallel_edges_are_not_sorted(spark):
    """The strongest level is found by hashing, ties and nulls as before."""
    rows = [(1, 2, -2), (1, 2, 2), (1, 2, 1), (3, 4, -1), (3, 4, 0), (5, 6, None), (5, 6, -3), (7, 8, None), (9, 9, 0)]
    found = dedup_edges(spark.createDataFrame(rows, "src long, dst long, level int"))
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.schema["level"].dataType.simpleString() == "int"
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 2, 2), (3, 4, -1), (5, 6, -3), (7, 8, None), (9, 9, 0)]


def test_layout_completes_nodes_from_sources_and_loose_targets(spark):
    """Ends without a node row on either side become nodes, in the layout as without; its tables declare no order to sort by."""
    nodes = spark.createDataFrame([(1, 2), (2, 1)], "node_id long, type_id int")
    edges = spark.createDataFrame([(1, 2, 0), (2, 3, 1), (4, 1, 0), (5, 6, -1)], "src long, dst long, level int")
    graph = build_graph(nodes, edges)
    laid = lay_out(graph, buckets=2)
    for g in (graph, laid):
        assert sorted((r.node_id, r.type_id, r.implicit) for r in g.nodes.collect()) == [
            (1, 2, False), (2, 1, False), (3, 0, True), (4, 0, True), (5, 0, True), (6, 0, True)
        ]
        assert sorted(g.edges.columns) == ["dst", "dst_type", "level", "src"]
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {laid.table}").collect()}
    assert told["Sort Columns"] == "[]" if "Sort Columns" in told else True
