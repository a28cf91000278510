"""Work that is shared, ended or laid side by side, with the same results."""

import threading

import pytest
from pyspark.sql import DataFrameWriter

from suite import queries
from tierwalk import ScoreParams, build_graph, chain_batch, lay_out, star_answers, star_visit
from tierwalk.operators import chain as chains
from tierwalk.operators import graph as graphs
from tierwalk.operators import visit as visits
from tierwalk.operators.totals import Totals
from tierwalk.params import SYNTHETIC
from tierwalk.plans import workload
from tierwalk.sources import parse_adjacency
from tierwalk.workspace import Log, Workspace, setting


def lane(spark, n=40, **layout):
    """Nodes 0 to n - 1 in a row with a few shortcuts, of types 0, 1 and 2 in turn, edges both ways."""
    pairs = [(i, i + 1) for i in range(n - 1)] + [(i, i + 7) for i in range(0, n - 7, 5)]
    nodes = spark.createDataFrame([(i, i % 3) for i in range(n)], "node_id long, type_id int")
    edges = [e for a, b in pairs for e in ((a, b, b % 2), (b, a, -(b % 2)))]
    return lay_out(build_graph(nodes, spark.createDataFrame(edges, "src long, dst long, level int")), **layout)


def test_ratios_run_side_by_side(spark, monkeypatch):
    """Every ratio is under way before one of them ends, and what they find is what they find one by one."""
    graph, ratios = lane(spark, buckets=2), (0.5, 0.8, 1.0)
    batch = chain_batch(spark, {1: [([(2, 2)], 0), ([(5, 2)], 1)], 2: [([(8, 2), (11, 2)], 0)]})
    params = ScoreParams(k=3, max_hops=4)
    before, shuffles = dict(spark.conf.getAll), "spark.sql.shuffle.partitions"
    want = [
        (r, *row)
        for r in ratios
        for row in workload.run_workload(workload.graph_fraction(graph, r) if r < 1 else graph, batch, SYNTHETIC, params).collect()
    ]
    together, run = threading.Barrier(len(ratios)), workload.run_workload

    def waiting(*args):
        together.wait(60)
        assert spark.conf.get(shuffles) == "2"
        return run(*args)

    monkeypatch.setattr(workload, "run_workload", waiting)
    got = workload.size_sweep(graph, batch, SYNTHETIC, params, ratios)
    assert sorted(map(str, got.collect())) == sorted(map(str, [got_row(got, w) for w in want])) and len(want) > 5
    assert dict(spark.conf.getAll) == before


def got_row(df, values):
    from pyspark.sql import Row

    return Row(*df.columns)(*values)


def test_a_setting_is_held_by_many(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    first, second = setting(spark, key, "7"), setting(spark, key, "7")
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(key) == "7"
    second.__exit__(None, None, None)
    assert spark.conf.get(key) == before
    with pytest.raises(KeyError), setting(spark, key, "9"), setting(spark, key, "11"):
        raise KeyError
    assert spark.conf.get(key) == before


def fork(spark):
    """From 0 to 1 in two hops, from 20 to 21 only in six, and a crowd behind 0."""
    far = [20, 30, 31, 32, 33, 34, 21]
    pairs = [(0, 10), (10, 1), (1, 20), *zip(far, far[1:])] + [(0, 50)] + [(50, n) for n in range(51, 70)]
    types = {n: 4 for pair in pairs for n in pair} | {0: 0, 1: 1, 20: 1, 21: 3}
    nodes = spark.createDataFrame(sorted(types.items()), "node_id long, type_id int")
    return lay_out(build_graph(nodes, spark.createDataFrame([(a, b, 0) for a, b in pairs], "src long, dst long, level int")), buckets=2)


@pytest.mark.parametrize("prune", [None, "bound"])
def test_only_links_that_miss_pairs_start_again(spark, monkeypatch, prune):
    """The first link ends under the shortest bound, so longer ones walk from the sources of the second only."""
    graph = fork(spark)
    rows = [(1, 0, 1, 0, 0, 0.9), (1, 1, 1, 1, 1, 0.9), (1, 2, 1, 21, 3, 0.9)]
    found = spark.createDataFrame(rows, "query_id long, star_id int, rank int, node_id long, type_id int, score double")
    batch = chain_batch(spark, {1: [([(0, 0)], 0), ([(1, 1)], 1), ([(21, 3)], 3)]})
    params, walk, walks = ScoreParams(prune=prune), chains.link_visit, []
    whole, targets = walk(graph, batch, found, SYNTHETIC, params)
    pairs = ["query_id", "star_id", "seed_id", "node_id", "dist", "closeness"]
    want = {tuple(r) for r in visits.seen_by_star(whole, targets).select(*pairs).collect()}

    def watched(*args):
        visit, targets = walk(*args)
        walks.append((args[4].max_hops, sorted(r.seed_id for r in visit.uses.select("seed_id").distinct().collect())))
        return visit, targets

    scans = []
    ids, monkeyed = visits.only_ids, lambda df, column, ids_: scans.append(column) or ids(df, column, ids_)
    monkeypatch.setattr(chains, "link_visit", watched)
    monkeypatch.setattr(visits, "only_ids", monkeyed)
    got, _ = chains.shortest_links(graph, batch, found, SYNTHETIC, params)
    there = {(0, 0, 1), (1, 1, 21)}
    seen = {tuple(r) for r in got.select(*pairs).collect()}
    assert {r for r in seen if r[1:4] in there} == {r for r in want if r[1:4] in there} and len({r[1:4] for r in seen} & there) == 2
    assert walks == [(3, [0, 1]), (4, [1]), (None, [1])]
    # One step back under a bound of 3, another under 4.
    assert scans.count("dst") == 2


def test_pruned_stars_end_with_their_answers(spark):
    """Once no open node can enter the k best, a pruned walk for answers goes no further, and its answers are those of the whole walk."""
    pairs = [(0, 2), (1, 2), (0, 3), (1, 3), (3, 4), (4, 5), (5, 6)]
    nodes = spark.createDataFrame([(n, {0: 4, 1: 4, 2: 0, 6: 0}.get(n, 1)) for n in range(7)], "node_id long, type_id int")
    graph = lay_out(build_graph(nodes, spark.createDataFrame([(a, b, 0) for a, b in pairs], "src long, dst long, level int")), buckets=2)
    batch, params = chain_batch(spark, {1: [([(0, 4), (1, 4)], 0)]}), ScoreParams(k=1, prune="bound")
    whole = star_visit(graph, batch, SYNTHETIC, params)
    short = star_visit(graph, batch, SYNTHETIC, params, answers_only=True)
    answers = [list(map(tuple, star_answers(v, 1).collect())) for v in (whole, short)]
    assert answers[0] == answers[1] and len(answers[0]) == 1
    assert sum(whole.hops) == 12 and sum(short.hops) < 12


@pytest.mark.parametrize("prune", [None, "bound"])
def test_a_large_frontier_goes_in_turns(spark, monkeypatch, prune):
    """Walk by walk in several writes, with the same pairs."""
    graph = lane(spark, 24, buckets=2)
    batch = chain_batch(spark, {1: [([(2, 2), (5, 2), (8, 2), (11, 2)], 0)]})
    params = ScoreParams(k=2, max_hops=3, prune=prune)
    columns = ("seed_id", "node_id", "dist", "n_paths", "closeness", "parent_id")

    def state():
        visit = star_visit(graph, batch, SYNTHETIC, params)
        return sorted(map(tuple, visit.state.select(*columns).collect())), visit.hops

    want, writes, append = state(), [], Log.append

    def watching(self, df, hop, **counted):
        if self.hop == "dist":
            writes.append(hop)
        return append(self, df, hop, **counted)

    monkeypatch.setattr(visits, "TURN_ROWS", 3)
    monkeypatch.setattr("tierwalk.workspace.SMALL", 10)
    monkeypatch.setattr(Log, "append", watching)
    assert state() == want
    assert writes.count(0) == 1 and writes.count(1) > 1 and writes.count(2) > writes.count(1) and max(map(writes.count, writes)) <= visits.TURNS


def test_totals_are_read_without_sorting(spark):
    """The last totals of a node are found by hashing, and a rule that asks for none of the scores logs none."""
    ws = Workspace(spark, "test")
    uses = spark.createDataFrame([(1, 0, 7, True, 0, 1)], "query_id long, star_id int, seed_id long, inherits boolean, dst_type int, n_seeds int")
    fresh = spark.createDataFrame([(7, True, n, 0, 0.5, 0.25, 0.25) for n in (1, 2)], "seed_id long, inherits boolean, node_id long, type_id int, closeness double, lower_bound double, upper_bound double")
    for sums in ((), ("score", "lower_bound")):
        totals = Totals(ws, ["seed_id", "inherits"], sums=sums, name=f"totals-{len(sums)}")
        try:
            for hop, some in ((1, fresh), (2, fresh.where("node_id = 2"))):
                totals.add(hop, some, uses)
            last = totals.latest(2)
            assert {r.node_id: tuple(r)[5:] for r in last.collect()} == {1: (1, 0.5, 0.25)[: 1 + len(sums)], 2: (2, 1.0, 0.5)[: 1 + len(sums)]}
            assert "SortAggregate" not in last._jdf.queryExecution().executedPlan().toString()
        finally:
            totals.close()


def test_types_are_found_without_sorting(spark):
    """Of rows with one id the least type counts, a null before any, and names stay out of it."""
    rows = [(1, 3, "b"), (1, 2, "c"), (2, None, "x"), (2, 1, "y"), (3, 1, "z")]
    nodes = spark.createDataFrame(rows, "node_id long, type_id int, name string")
    edges = spark.createDataFrame([(3, n, 0) for n in (1, 2, 4)], "src long, dst long, level int")
    found = build_graph(nodes, edges, default_type=9).edges
    assert {r.dst: r.dst_type for r in found.collect()} == {1: 2, 2: 9, 4: 9}
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_layouts_leave_no_shuffle_files(spark, monkeypatch):
    """Every table of a layout is written by a statement that drops its shuffle files."""
    key, seen, save = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], DataFrameWriter.saveAsTable

    def watching(self, *args, **kwargs):
        seen.append(spark.conf.get(key))
        return save(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "saveAsTable", watching)
    lane(spark, 12, buckets=2)
    assert seen == ["true", "true"] and spark.conf.get(key) != "true"


def test_hubs_are_looked_for_in_full_cells_only(spark, monkeypatch):
    edges = spark.createDataFrame([(1, n) for n in range(30)] + [(n, 1) for n in range(2, 30)], "src long, dst long")
    assert {r.src for r in graphs.crowded(edges, 20).select("src").distinct().collect()} == {1}
    assert graphs.crowded(edges, 40).count() == 0
    monkeypatch.setattr(graphs, "CELLS", 1)
    assert graphs.crowded(edges, 20).count() == 58


def test_adjacency_is_cut_without_patterns(spark):
    """No pattern runs over the text, and sections in any order, repeated or glued to other words are cut where they were."""
    texts = {
        1: "same: 1 lower: 2 higher: 3 same: 4",
        2: "higher:   1 2   lower: 3",
        3: "xsame: 4",
        4: "higher: 1 2lower: 3",
        5: "higher: 1 lower:2 same:3",
        6: "é: ü higher: 5 6 same: 7",
        7: "higher:   ",
    }
    lines = spark.createDataFrame([(f"{n}\t0\t{t}",) for n, t in texts.items()], "value string")
    edges = parse_adjacency(lines)[1]
    text = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in text.lower() and "rlike" not in text.lower()
    got = sorted(tuple(r) for r in edges.select("src", "dst", "level").collect())
    assert got == [(1, 1, 0), (1, 2, -1), (1, 3, 1), (2, 1, 1), (2, 2, 1), (2, 3, -1), (3, 4, 0), (4, 1, 1), (4, 3, -1), (5, 1, 1), (6, 5, 1), (6, 6, 1), (6, 7, 0)]


def test_text_files_are_packed(spark, monkeypatch):
    """The files of a workload are compressed, and short enough for a task to take several of them."""
    written, text = [], DataFrameWriter.text

    def watching(self, path, *args, **kwargs):
        text(self, path, *args, **kwargs)
        written.append([f.split("/")[-1] for f in spark.read.text(path).inputFiles()])

    monkeypatch.setattr(DataFrameWriter, "text", watching)
    monkeypatch.setattr(queries, "FILE_LINES", 10_000)
    monkeypatch.setattr(queries, "run_workload", lambda *args: spark.range(0).selectExpr("id as query_id", "array(id) as node_ids", "0.5D as score"))
    queries.file_workload(spark, "/root/testdata/sf0.001")
    edges, nodes = written[:2]
    assert len(edges) >= 3 and all(name.endswith(".txt.gz") for name in edges + nodes)
