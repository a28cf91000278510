"""Readers and parsers, with the corner cases of each format."""

import pytest

from tierwalk import ScoreParams, build_graph
from tierwalk.params import SYNTHETIC
from tierwalk.plans.workload import size_sweep_files
from tierwalk.sinks import write_answers, write_run_metrics
from tierwalk.sources import (
    parse_adjacency,
    parse_edge_lines,
    parse_node_lines,
    parse_node_table_lines,
    parse_query_lines,
    parse_star_sets,
    pick_seeds,
    read_adjacency,
    read_edge_list,
    read_node_info,
    read_node_table,
    read_queries,
    read_star_sets,
)


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def numbered(spark, *values):
    return spark.createDataFrame(list(enumerate(values, 1)), "query_id long, value string")


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_edge_lines(spark):
    text = lines(spark, "1\t2\tsame", "1\t3\thigher", "3\t1\tlower", "5\t6\tfoo", "")
    assert tuples(parse_edge_lines(text)) == [(1, 2, 0), (1, 3, 1), (3, 1, -1), (5, 6, -1)]
    assert tuples(parse_edge_lines(lines(spark, "1|2|same"), sep="|")) == [(1, 2, 0)]
    with pytest.raises(Exception, match="unknown edge label"):
        parse_edge_lines(text, strict=True).collect()


def test_node_lines(spark):
    got = parse_node_lines(lines(spark, '"a b+++ 4"\t12', "c+++0\t7"))
    assert tuples(got) == [(12, 4, "a b", '"a b+++ 4"'), (7, 0, "c", "c+++0")]


def test_node_table_lines(spark):
    assert tuples(parse_node_table_lines(lines(spark, "3\tx y\t4\tTECH", "4\tz\t1"))) == [(3, 4, "x y"), (4, 1, "z")]


@pytest.mark.parametrize(
    "text, edges, sentinels",
    [
        ("higher: 1 2 lower: 3 same: 4", [(1, 1), (2, 1), (3, -1), (4, 0)], 0),
        ("same: 4 higher: 1 lower: 3 5", [(4, 0), (1, 1), (3, -1), (5, -1)], 0),
        ("higher: 1 lower: 3 same: ", [(1, 1), (3, -1)], 1),
        ("higher: lower: 3", [(3, -1)], 0),
        ("higher:  lower: 3", [(3, -1)], 1),
        ("same:  ", [], 0),
        ("same: ", [], 1),
        ("", [], 0),
        ("lower: 8 ", [(8, -1)], 0),
    ],
)
def test_adjacency(spark, text, edges, sentinels):
    row = lines(spark, f"9\t4\t{text}")
    nodes, plain = parse_adjacency(row)
    assert tuples(nodes) == [(9, 4)]
    assert tuples(plain) == sorted(((9, n, level) for n, level in edges), key=repr)
    kept = parse_adjacency(row, keep_sentinel=True)[1]
    assert kept.filter("dst = -10001 AND level = 0").count() == sentinels
    assert kept.count() == len(edges) + sentinels


def test_adjacency_rejects_garbage(spark):
    with pytest.raises(Exception):
        parse_adjacency(lines(spark, "9\t4\tsame: x"))[1].collect()


def test_query_lines(spark):
    seeds, stars = parse_query_lines(numbered(spark, "1,2;2,2;0\t20,4;21,4;0", "5,1;3"))
    assert tuples(seeds) == [(1, 0, 1, 2), (1, 0, 2, 2), (1, 1, 20, 4), (1, 1, 21, 4), (2, 0, 5, 1)]
    assert tuples(stars) == [(1, 0, 0), (1, 1, 0), (2, 0, 3)]


def test_star_sets(spark):
    got = parse_star_sets(numbered(spark, "1,2;2,2\t20,4"))
    assert tuples(got) == [(1, 0, 1, 2), (1, 0, 2, 2), (1, 1, 20, 4)]


def test_pick_seeds(spark):
    nodes = spark.createDataFrame([(i, 1 if i % 2 else 0) for i in range(100)], "node_id long, type_id int")
    # Odd ids have a seed type: places 10, 20 and 30 are ids 21, 41 and 61.
    assert tuples(pick_seeds(nodes, 3)) == [(21, 1), (41, 1), (61, 1)]


def test_files(spark, tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert tuples(read_edge_list(spark, write("e", "1\t2\thigher\n"))) == [(1, 2, 1)]
    assert tuples(read_node_info(spark, write("n", '"x+++3"\t1\n'))) == [(1, 3, "x", '"x+++3"')]
    assert tuples(read_node_table(spark, write("t", "1\tx\t3\n"))) == [(1, 3, "x")]
    nodes, edges = read_adjacency(spark, write("a", "1\t3\thigher: 2\n2\t0\tlower: 1\n"))
    assert build_graph(nodes, edges).edges.count() == 2
    seeds, stars = read_queries(spark, write("q", "1,2;0\n3,2;4,2;1\t5,1;0\n"))
    assert [r.query_id for r in stars.orderBy("query_id", "star_id").collect()] == [0, 1, 1]
    assert tuples(seeds) == [(0, 0, 1, 2), (1, 0, 3, 2), (1, 0, 4, 2), (1, 1, 5, 1)]
    assert tuples(read_star_sets(spark, write("s", "1,2;2,2\n"))) == [(0, 0, 1, 2), (0, 0, 2, 2)]


def test_file_sweep_and_sinks(spark, tmp_path):
    for ratio in (0.5, 1.0):
        folder = tmp_path / f"graph{ratio}"
        folder.mkdir()
        (folder / f"nodeInfoPart{ratio}").write_text('"a+++2"\t1\n"b+++0"\t2\n"c+++0"\t3\n')
        (folder / f"edgeListPart{ratio}").write_text("1\t2\thigher\n" + ("1\t3\tsame\n" if ratio == 1 else ""))
        (tmp_path / f"query{ratio}").write_text("1,2;0\n")
    got = size_sweep_files(
        spark, f"{tmp_path}/graph", f"{tmp_path}/query", SYNTHETIC, ScoreParams(max_hops=1), (0.5, 1.0)
    )
    assert tuples(got.select("ratio", "rank", "node_ids")) == [(0.5, 1, [2]), (1.0, 1, [2]), (1.0, 2, [3])]

    out = str(tmp_path / "out")
    write_answers(got, out, files=1)
    write_answers(spark.read.parquet(out).limit(2), f"{out}2")
    write_answers(got, f"{out}3", fmt="csv")
    write_answers(got, f"{out}4", fmt="text")
    write_answers(got, f"{out}5", fmt="json")
    write_answers(got.limit(1), out)
    assert spark.read.parquet(out).count() == 1
    assert spark.read.parquet(f"{out}2").count() == 2
    assert spark.read.csv(f"{out}3").count() == spark.read.json(f"{out}5").count() == 3
    assert "[3]" in "".join(r.value for r in spark.read.text(f"{out}4").collect())
    for millis in (5, 6):
        write_run_metrics(spark, f"{out}-runs", "star", 5, millis)
    assert tuples(spark.read.parquet(f"{out}-runs")) == [("star", 5, 5), ("star", 5, 6)]


def test_separators_need_no_pattern(spark):
    """A plain separator is not quoted, one with a meaning in patterns is."""
    lines = spark.createDataFrame([("1|2|higher",)], "value string")
    assert [tuple(r) for r in parse_edge_lines(lines, "|").collect()] == [(1, 2, 1)]
    plain = parse_edge_lines(spark.createDataFrame([("1\t2\thigher",)], "value string"))
    assert "\\Q" not in plain._jdf.queryExecution().analyzed().toString()
    assert [tuple(r) for r in plain.collect()] == [(1, 2, 1)]


def test_adjacency_sections_are_cut_before_they_are_split(spark):
    texts = {
        1: "higher: 2 3 lower: 4 same: 5",
        2: "lower:  6 same:",
        3: "same: 7 8 ",
        4: "higher: lower: 9",
        5: "higher: 1 xlower: 2",
    }
    lines = spark.createDataFrame([(f"{n}\t0\t{t}",) for n, t in texts.items()], "value string")
    edges = parse_adjacency(lines)[1]
    assert "rlike" not in edges._jdf.queryExecution().analyzed().toString().lower()
    got = sorted(tuple(r) for r in edges.select("src", "dst", "level").collect())
    assert got == [(1, 2, 1), (1, 3, 1), (1, 4, -1), (1, 5, 0), (2, 6, -1), (3, 7, 0), (3, 8, 0), (4, 9, -1), (5, 1, 1), (5, 2, -1)]
