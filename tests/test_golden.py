"""Worked values on the seven-node graph."""

import pytest

from tierwalk import (
    ScoreParams,
    answer_details,
    answer_paths,
    batch_star_query,
    build_graph,
    chain_batch,
    compare_hierarchy,
    general_query,
    lay_out,
    shortest_path,
    star_answers,
    star_batch,
    star_query,
    star_visit,
    visited_any,
)
from tierwalk.operators.visit import seen_by_star, visit_metrics
from tierwalk.params import SYNTHETIC
from tierwalk.plans.presets import run_preset
from tierwalk.plans.workload import chain_k_sweep, top_k_sweep

NODES = [(1, 2), (2, 2), (10, 0), (11, 0), (12, 0), (20, 4), (21, 4)]
EDGES = [
    (1, 10, 1),
    (1, 20, 0),
    (2, 20, 0),
    (2, 11, 1),
    (20, 11, 0),
    (10, 20, 0),
    (20, 12, 1),
    (21, 12, 0),
    (1, 21, 0),
]
A = ([(1, 2), (2, 2)], 0)
B = ([(20, 4), (21, 4)], 0)


@pytest.fixture(scope="module")
def graph(spark):
    return make_graph(spark, "pieces")


def make_graph(spark, layout):
    nodes = spark.createDataFrame([(n, t, f"n{n}") for n, t in NODES], "node_id long, type_id int, name string")
    both = EDGES + [(d, s, -level) for s, d, level in EDGES]
    plain = build_graph(nodes, spark.createDataFrame(both, "src long, dst long, level int"))
    if layout == "plain":
        return plain
    laid = lay_out(plain, buckets=3, piece_rows=2 if layout == "pieces" else None)
    assert (laid.hubs is not None) == (layout == "pieces")
    return laid


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


@pytest.mark.parametrize("layout", ["plain", "bucketed", "pieces"])
def test_visit(spark, layout):
    graph = make_graph(spark, layout)
    visit = star_visit(graph, star_batch(spark, *A), SYNTHETIC, ScoreParams())
    got = {
        (r.node_id, r.seed_id): (
            r.dist,
            r.n_paths,
            round(r.hier, 6),
            round(r.closeness, 6),
            round(r.lower_bound, 6),
            r.parent_id,
        )
        for r in seen_by_star(visit).collect()
    }
    assert got == {
        (1, 1): (0, 1, 0, 0, 1, None),
        (1, 2): (2, 1, 0, 0.81, 0.81, 20),
        (2, 1): (2, 1, 0, 0.81, 0.81, 20),
        (2, 2): (0, 1, 0, 0, 1, None),
        (10, 1): (1, 1, 0.8, 0.979148, 0.979148, 1),
        (10, 2): (2, 1, 0, 0.81, 0.81, 20),
        (11, 1): (2, 1, 0, 0.81, 0.81, 20),
        (11, 2): (1, 1, 0.8, 0.979148, 0.979148, 2),
        (12, 1): (2, 2, 0.8, 0.890567, 0.890567, 20),
        (12, 2): (2, 1, 0.8, 0.881234, 0.881234, 20),
        (20, 1): (1, 1, 0, 0.9, 0.9, 1),
        (20, 2): (1, 1, 0, 0.9, 0.9, 2),
        (21, 1): (1, 1, 0, 0.9, 0.9, 1),
        (21, 2): (3, 2, 0.8, 0.871998, 0.871998, 1),
    }
    assert visited_any(visit).count() == 7
    assert sum(n for _, n in rows(visit_metrics(visit), "hop", "new_pairs")) == 14
    # Upper bounds of visited pairs are their lower bounds.
    assert seen_by_star(visit).filter("upper_bound <> lower_bound").count() == 0


@pytest.mark.parametrize(
    "star, hierarchy, expected",
    [
        (A, True, [(10, 1.789148, 1.789148), (11, 1.789148, 1.789148), (12, 1.771801, 1.771801)]),
        (A, False, [(10, 1.71, 1.719533), (11, 1.71, 1.719533), (12, 1.628579, 1.637159)]),
        (B, True, [(12, 1.8, 1.809533), (10, 1.71, 1.718579), (11, 1.701511, 1.636721)]),
    ],
)
def test_star_answers(spark, graph, star, hierarchy, expected):
    params = ScoreParams(hierarchy=hierarchy)
    answers = batch_star_query(graph, star_batch(spark, *star), SYNTHETIC, params)
    got = rows(answers.orderBy("rank"), "node_id", "score", "lower_bound")
    assert [(n, round(s, 6), round(b, 6)) for n, s, b in got] == expected


def test_named_answers_and_preset(graph):
    named = star_query(graph, *A, SYNTHETIC, ScoreParams(k=2))
    assert rows(named.orderBy("rank"), "rank", "name") == [(1, "n10"), (2, "n11")]
    assert rows(run_preset(graph, "synthetic_tiny", ScoreParams(k=1)), "node_id") == [(10,)]


CHAIN = [
    ([10, 12], 4.399148),
    ([11, 12], 4.399148),
    ([11, 10], 4.309148),
    ([10, 11], 4.300659),
    ([12, 10], 4.291801),
    ([12, 11], 4.283311),
    ([12, 12], 3.571801),
    ([10, 10], 3.499148),
    ([11, 11], 3.490659),
]


def chains(graph, spark, queries, **params):
    out = general_query(graph, chain_batch(spark, queries), SYNTHETIC, ScoreParams(max_hops=3, **params))
    got = {}
    for query_id, ids, score in rows(out.orderBy("rank"), "query_id", "node_ids", "score"):
        got.setdefault(query_id, []).append((ids, round(score, 6)))
    return got


def test_chain(spark, graph):
    assert chains(graph, spark, {7: [A, B], 8: [A]}, k=9) == {
        7: CHAIN,
        8: [([10], 1.789148), ([11], 1.789148), ([12], 1.771801)],
    }


def test_chain_of_distinct_nodes(spark, graph):
    assert chains(graph, spark, {7: [A, B]}, k=9, distinct_nodes=True) == {7: CHAIN[:6]}


def test_chain_hands_on_star_k(spark, graph):
    # One answer per star is left: (10) and (12).
    assert chains(graph, spark, {7: [A, B]}, k=9, star_k=1) == {7: [([10, 12], 4.399148)]}


def test_paths(spark, graph):
    visit = star_visit(graph, star_batch(spark, *A), SYNTHETIC, ScoreParams())
    paths = {
        (r.node_id, r.seed_id): r.path for r in answer_paths(visit, star_answers(visit, 5)).collect()
    }
    assert paths[12, 1] == [1, 20, 12]
    assert paths[12, 2] == [2, 20, 12]
    assert paths[10, 2] == [2, 20, 10]
    assert len(paths) == 6


def test_shortest_path(spark, graph):
    def path(src, dst, hops=None):
        return rows(shortest_path(graph, src, dst, SYNTHETIC, max_hops=hops), "path")[0][0]

    assert path(2, 21) == [2, 20, 1, 21]
    assert path(2, 2) == [2]
    assert path(2, 999, 1) == []


def test_details(spark, graph):
    visit = star_visit(graph, star_batch(spark, *A), SYNTHETIC, ScoreParams())
    detail = answer_details(visit, star_answers(visit, 1)).first().detail
    assert [(d.seed_id, d.dist, d.parent_id) for d in detail] == [(1, 1, 1), (2, 2, 20)]


def test_compare_hierarchy(spark, graph):
    got = compare_hierarchy(graph, star_batch(spark, *A), SYNTHETIC, ScoreParams())
    assert {r.node_id: (r.rank_on, r.rank_off) for r in got.collect()} == {10: (1, 1), 11: (2, 2), 12: (3, 3)}
    assert got.filter("score_on < score_off").count() == 0


def test_sweeps(spark, graph):
    got = top_k_sweep(graph, star_batch(spark, *A), SYNTHETIC, ScoreParams(), ks=(1, 2, 5))
    assert sorted(rows(got, "k", "node_id")) == [(1, 10), (2, 10), (2, 11), (5, 10), (5, 11), (5, 12)]
    bounded = ScoreParams(max_hops=2)
    runs = chain_k_sweep(graph, chain_batch(spark, {1: [A, B]}), SYNTHETIC, bounded, ks=(1, 2))
    assert sorted((k, ids) for k, ids in rows(runs, "k", "node_ids")) == [(1, [10, 12]), (2, [10, 12]), (2, [11, 12])]
