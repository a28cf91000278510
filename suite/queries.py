"""Registered queries: every operator on the commerce graph of the given tables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from suite import oracle as o
from tierwalk import (
    Graph,
    ScoreParams,
    answer_details,
    answer_paths,
    batch_star_query,
    build_graph,
    build_property_graph,
    candidates,
    chain_batch,
    compare_hierarchy,
    general_query,
    graph_fraction,
    graph_stats,
    lay_out,
    link_candidates,
    lookup_nodes,
    remove_edges,
    shortest_path,
    star_answers,
    star_query,
    star_visit,
    triplets,
    visited_any,
    with_type_names,
    with_wanted_type,
)
from tierwalk.functions import inherits
from tierwalk.operators.graph import dedup_edges, preview, type_counts
from tierwalk.operators.visit import seen_by_star, visit_metrics
from tierwalk.params import COMMERCE
from tierwalk.plans.decompose import decompose_query as decompose
from tierwalk.operators.batch import Batch
from tierwalk.operators.chain import link_visit
from tierwalk.plans.presets import GENERAL_PRESETS, run_general_preset
from tierwalk.plans.workload import (
    SWEEP_K,
    SWEEP_RATIOS,
    chain_k_sweep,
    run_workload,
    size_sweep,
    top_k_sweep,
)
from tierwalk.sinks import write_answers, write_run_metrics
from tierwalk.sources import (
    commerce_graph,
    commerce_tables,
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
    read_queries,
)
from tierwalk.sources.commerce import ID_SPAN
from tierwalk.workspace import Workspace

HOPS, K = 3, 5
# Lines of a compressed text file.
FILE_LINES = 250_000
PARAMS = ScoreParams(k=K, max_hops=HOPS)
STAR = ["query_id", "star_id"]

C1 = [([(2000000002, 2), (3000000007, 3), (1000000003, 1)], 0)]
C2 = [*C1, ([(5000000001, 5), (4000000010, 4)], 3)]
C3 = [*C2, ([(6000000002, 6), (2000000005, 2)], 1)]
STAR_ONLY = {1: C1}
PRESET_CHAINS = GENERAL_PRESETS["commerce"].chains
TWO = {2: C2}
THREE = {3: C3}
WORKLOAD = {1: C1, 2: C2, 3: C3}
PATH_ENDS = (2000000002, 6000000002)

# A chain in which answers beyond the first k of its stars make better tuples.
DEEP = {3: [([(2000000015, 2), (3000000967, 3)], 0), ([(5000000020, 5), (4000006219, 4)], 3)]}
REPEATED = {1: [([*C1[0][0], C1[0][0][0]], 0)]}

# Queries for fractions of the graph, with seeds that fall into the fraction.
SIZE_HOPS = 6
_SMALL = {1: [([(5000000024, 5)], 3)], 2: [([(5000000024, 5)], 3), ([(5000000024, 5)], 4)]}
_PART = ([(2000000007, 2), (3000000038, 3), (1000000026, 1)], 0)
_BUYER = ([(5000000024, 5), (4000007665, 4)], 3)
_LARGE = {1: [_PART], 2: [_PART, _BUYER], 3: [_PART, _BUYER, ([(6000000002, 6), (2000000007, 2)], 1)]}


def size_chains(ratio: float) -> dict:
    return _LARGE if ratio >= 0.5 else _SMALL


_GRAPHS: dict[tuple[str, str], Graph] = {}


def graph_of(spark: SparkSession, folder: str) -> Graph:
    """The laid out graph of a folder, written once per session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _GRAPHS:
        _GRAPHS[key] = lay_out(commerce_graph(spark, folder))
    return _GRAPHS[key]


def nodes_of(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of a folder's graph, from its layout if there is one; none is written for them."""
    key = (spark.sparkContext.applicationId, folder)
    return (_GRAPHS.get(key) or commerce_graph(spark, folder)).nodes


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _answers(df: DataFrame) -> DataFrame:
    return _rounded(df, "score", "lower_bound", "upper_bound").select(
        *STAR, "rank", "node_id", "type_id", "score", "lower_bound", "upper_bound"
    )


def _ids(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


def _tuples(df: DataFrame) -> DataFrame:
    return _rounded(df.withColumn("node_ids", _ids("node_ids")), "score")


def _label(level: Column) -> Column:
    return F.when(level == 0, "same").when(level == 1, "higher").otherwise("lower")


def _star(spark, folder, chains=STAR_ONLY, **changes) -> DataFrame:
    batch = chain_batch(spark, chains)
    return _answers(batch_star_query(graph_of(spark, folder), batch, COMMERCE, PARAMS.with_(**changes)))


def _chain(spark, folder, chains, **changes) -> DataFrame:
    batch = chain_batch(spark, chains)
    return _tuples(general_query(graph_of(spark, folder), batch, COMMERCE, PARAMS.with_(**changes)))


def _visit(spark, folder, hops=HOPS, **options):
    batch = chain_batch(spark, STAR_ONLY)
    return star_visit(graph_of(spark, folder), batch, COMMERCE, PARAMS.with_(max_hops=hops), **options)


# --- graph -------------------------------------------------------------------------


def graph_nodes(spark, folder):
    return graph_of(spark, folder).nodes.select("node_id", "type_id", "name", "implicit")


def graph_edges(spark, folder):
    return graph_of(spark, folder).edges.select("src", "dst", "level", "dst_type")


def graph_counts(spark, folder):
    return graph_stats(graph_of(spark, folder))


def type_sizes(spark, folder):
    return type_counts(graph_of(spark, folder))


def implicit_nodes(spark, folder):
    nodes, edges = commerce_tables(spark, folder)
    graph = build_graph(nodes.filter(F.col("type_id") != 1), edges)
    return graph.nodes.filter("implicit").select("node_id", "type_id")


def edge_dedup(spark, folder):
    sold = spark.read.parquet(f"{folder}/lineitem.parquet")
    raw = sold.select(
        F.col("l_partkey").alias("src"),
        F.col("l_suppkey").alias("dst"),
        (F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", -1).otherwise(0)).alias(
            "level"
        ),
    )
    return dedup_edges(raw)


def triplet_view(spark, folder):
    return triplets(graph_of(spark, folder))


def type_names(spark, folder):
    named = with_type_names(graph_of(spark, folder).nodes, COMMERCE)
    return named.select("node_id", "type_id", "type_name")


def property_graph(spark, folder):
    customer = spark.read.parquet(f"{folder}/customer.parquet")
    nation = spark.read.parquet(f"{folder}/nation.parquet")
    vertices = customer.select(F.col("c_name").alias("id"), F.lit("customer").alias("kind")).unionByName(
        nation.select(F.col("n_name").alias("id"), F.lit("nation").alias("kind"))
    )
    lives = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_name").alias("src"), F.col("n_name").alias("dst"), F.lit("lives_in").alias("relationship")
    )
    _, edges = build_property_graph(vertices, lives)
    return edges.select("src", "dst", "relationship", "src_id", "dst_id")


def fraction_edges(spark, folder):
    return graph_fraction(graph_of(spark, folder), 0.5).edges.select("src", "dst", "level")


def fraction_nodes(spark, folder):
    return graph_fraction(graph_of(spark, folder), 0.2).nodes.select("node_id", "type_id")


def removed_edges(spark, folder):
    sold = spark.read.parquet(f"{folder}/lineitem.parquet").filter("l_returnflag = 'R'")
    pairs = sold.select(
        F.col("l_partkey").alias("src"),
        (F.col("l_orderkey") + 4 * ID_SPAN).alias("dst"),
    )
    return remove_edges(graph_of(spark, folder), pairs).edges.select("src", "dst", "level")


def looked_up_nodes(spark, folder):
    returned = spark.read.parquet(f"{folder}/lineitem.parquet").filter("l_returnflag = 'R'")
    ids = returned.select((F.col("l_suppkey") + ID_SPAN).alias("node_id"))
    return lookup_nodes(graph_of(spark, folder), ids).select("node_id", "type_id", "name")


def inherit_pairs(spark, folder):
    present = type_counts(graph_of(spark, folder))
    every_type = F.explode(F.array(*map(F.lit, range(len(COMMERCE.type_names)))))
    pairs = present.select(F.col("type_id").alias("type_a"), every_type.alias("type_b"))
    return pairs.filter(inherits(F.col("type_a"), F.col("type_b"), COMMERCE))


# --- text sources, on lines made from the tables --------------------------------------


def edge_lines(spark, folder):
    edges = graph_of(spark, folder).edges
    lines = edges.select(F.concat_ws("\t", "src", "dst", _label(F.col("level"))).alias("value"))
    return parse_edge_lines(lines)


def node_lines(spark, folder):
    nodes = graph_of(spark, folder).nodes
    label = F.concat(F.lit('"'), "name", F.lit("+++ "), F.col("type_id").cast("string"), F.lit('"'))
    return parse_node_lines(nodes.select(F.concat_ws("\t", label, "node_id").alias("value")))


def node_table_lines(spark, folder):
    nodes = graph_of(spark, folder).nodes
    return parse_node_table_lines(nodes.select(F.concat_ws("\t", "node_id", "name", "type_id").alias("value")))


def _adjacency_lines(spark, folder):
    text = F.concat_ws(
        " ",
        F.lit("higher:"),
        "l_partkey",
        "l_linenumber",
        F.lit("lower:"),
        "l_suppkey",
        F.lit("same:"),
        F.when(F.col("l_returnflag") == "R", F.col("l_partkey").cast("string")).otherwise(""),
    )
    sold = spark.read.parquet(f"{folder}/lineitem.parquet")
    return sold.select(F.concat_ws("\t", "l_orderkey", F.lit(4), text).alias("value"))


def adjacency_edges(spark, folder):
    return parse_adjacency(_adjacency_lines(spark, folder), keep_sentinel=True)[1]


def adjacency_nodes(spark, folder):
    return parse_adjacency(_adjacency_lines(spark, folder))[0]


def _query_lines(spark, folder, wanted: bool):
    first = F.concat(
        F.col("l_partkey"), F.lit(",0;"), F.col("l_suppkey"), F.lit(",1"), F.lit(";3" if wanted else "")
    )
    second = F.concat(F.col("l_orderkey"), F.lit(",4"), F.lit(";0" if wanted else ""))
    sold = spark.read.parquet(f"{folder}/lineitem.parquet")
    return sold.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("query_id"),
        F.concat_ws("\t", first, second).alias("value"),
    )


def query_line_seeds(spark, folder):
    return parse_query_lines(_query_lines(spark, folder, True))[0]


def query_line_stars(spark, folder):
    return parse_query_lines(_query_lines(spark, folder, True))[1]


def star_set_seeds(spark, folder):
    return parse_star_sets(_query_lines(spark, folder, False))


def picked_seeds(spark, folder):
    return pick_seeds(nodes_of(spark, folder), 50)


# --- visits and stars ----------------------------------------------------------------

VISIT_OUT = [
    *STAR,
    "seed_id",
    "node_id",
    "type_id",
    "dist",
    "n_paths",
    "hier",
    "closeness",
    "lower_bound",
    "parent_id",
]


def _visit_rows(visit):
    return _rounded(seen_by_star(visit), "hier", "closeness", "lower_bound").select(*VISIT_OUT)


def propagate_one_hop(spark, folder):
    return _visit_rows(_visit(spark, folder, 1))


def visit_rows(spark, folder):
    return _visit_rows(_visit(spark, folder))


def visited_nodes(spark, folder):
    return visited_any(_visit(spark, folder))


def candidate_nodes(spark, folder):
    return _rounded(candidates(_visit(spark, folder)), "score", "lower_bound", "upper_bound")


def named_star_query(spark, folder):
    seeds, dst_type = C1[0]
    rows = star_query(graph_of(spark, folder), seeds, dst_type, COMMERCE, PARAMS)
    return _rounded(rows, "score").select("rank", "node_id", "name", "score")


def star_details(spark, folder):
    visit = _visit(spark, folder, answers_only=True)
    rows = answer_details(visit, star_answers(visit, K))
    return _rounded(
        rows.select("rank", "node_id", F.inline("detail")), "closeness", "lower_bound"
    ).select("rank", "node_id", "seed_id", "dist", "n_paths", "closeness", "lower_bound", "parent_id")


def hierarchy_on_off(spark, folder):
    batch = chain_batch(spark, STAR_ONLY)
    rows = compare_hierarchy(graph_of(spark, folder), batch, COMMERCE, PARAMS)
    return _rounded(rows, "score_on", "score_off")


def _nation_batch(spark, folder):
    nation = spark.read.parquet(f"{folder}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("n"))
    seeds = nation.select(
        F.col("n").alias("query_id"),
        F.lit(0).alias("star_id"),
        F.inline(
            F.array(
                F.struct((F.col("n") + 5 * ID_SPAN).alias("seed_id"), F.lit(5).alias("seed_type")),
                F.struct((F.col("n") + 1 + 2 * ID_SPAN).alias("seed_id"), F.lit(2).alias("seed_type")),
            )
        ),
    )
    return with_wanted_type(seeds, 0)


def nation_workload(spark, folder):
    return _answers(
        batch_star_query(graph_of(spark, folder), _nation_batch(spark, folder), COMMERCE, PARAMS)
    )


def _nation_chains(spark, folder):
    """Per nation: a part close to it and to a brand, then a customer close to its region."""
    parts = _nation_batch(spark, folder)
    region = spark.read.parquet(f"{folder}/nation.parquet").select(
        F.col("n_nationkey").cast("bigint").alias("query_id"),
        F.lit(1).alias("star_id"),
        (F.col("n_regionkey") + 6 * ID_SPAN).alias("seed_id"),
        F.lit(6).alias("seed_type"),
    )
    return parts.union(with_wanted_type(region, 3))


def nation_chains(spark, folder):
    batch = _nation_chains(spark, folder)
    return _tuples(run_workload(graph_of(spark, folder), batch, COMMERCE, PARAMS))


def k_sweep(spark, folder):
    batch = chain_batch(spark, STAR_ONLY)
    rows = top_k_sweep(graph_of(spark, folder), batch, COMMERCE, PARAMS)
    return _rounded(rows, "score").select("k", "query_id", "rank", "node_id", "score")


# --- chains --------------------------------------------------------------------------


def _links(spark, folder, **changes):
    graph, batch, params = graph_of(spark, folder), chain_batch(spark, THREE), PARAMS.with_(**changes)
    answers, _ = Workspace(spark, "links").save(batch_star_query(graph, batch, COMMERCE, params), "answers")
    rows = link_candidates(graph, batch, answers, COMMERCE, params)
    return _rounded(rows, "closeness", "pair_score").select(
        *STAR, "source_id", "target_id", "closeness", "pair_score"
    )


def found_paths(spark, folder):
    visit = _visit(spark, folder, answers_only=True)
    paths = answer_paths(visit, star_answers(visit, K))
    return paths.withColumn("path", _ids("path"))


def path_between(spark, folder, max_hops=6):
    rows = shortest_path(graph_of(spark, folder), *PATH_ENDS, COMMERCE, max_hops=max_hops)
    return rows.withColumn("path", _ids("path"))


def hop_metrics(spark, folder):
    return visit_metrics(_visit(spark, folder))


def previewed(spark, folder):
    return preview(triplets(graph_of(spark, folder)).orderBy("src", "dst"), 5)


def adjacency_file_query(spark, folder):
    """Adjacency lines in files to answers: the graph is read back from one line per node."""
    root, graph = Workspace(spark, "files").path, graph_of(spark, folder)

    def run(word: str, level: int) -> Column:
        ids = F.array_join(F.collect_list(F.when(F.col("level") == level, F.col("dst").cast("string"))), " ")
        return F.concat(F.lit(f"{word}: "), ids)

    lists = graph.edges.groupBy("src").agg(F.concat_ws(" ", run("higher", 1), run("lower", -1), run("same", 0)).alias("text"))
    lines = graph.nodes.join(lists, graph.nodes["node_id"] == lists["src"]).select(F.concat_ws("\t", "node_id", "type_id", "text"))
    lines.write.text(f"{root}/adjacency")
    nodes, edges = read_adjacency(spark, f"{root}/adjacency")
    read = lay_out(build_graph(nodes, edges))
    return _answers(batch_star_query(read, chain_batch(spark, STAR_ONLY), COMMERCE, PARAMS))


def workload(spark, folder):
    batch = chain_batch(spark, WORKLOAD)
    return _tuples(run_workload(graph_of(spark, folder), batch, COMMERCE, PARAMS))


def chain_sweep(spark, folder):
    batch = chain_batch(spark, TWO)
    return _tuples(chain_k_sweep(graph_of(spark, folder), batch, COMMERCE, PARAMS))


def graph_size_sweep(spark, folder):
    params = PARAMS.with_(max_hops=SIZE_HOPS)
    rows = size_sweep(
        graph_of(spark, folder), lambda r: chain_batch(spark, size_chains(r)), COMMERCE, params
    )
    return _tuples(rows)


def coverage_visit(spark, folder):
    """Unbounded: the rule alone ends the stars."""
    params = PARAMS.with_(stop="coverage", max_hops=None)
    return _visit_rows(star_visit(graph_of(spark, folder), chain_batch(spark, THREE), COMMERCE, params))


def pruned_visit(spark, folder, max_hops=HOPS):
    batch = chain_batch(spark, THREE)
    params = PARAMS.with_(prune="bound", max_hops=max_hops)
    return _visit_rows(star_visit(graph_of(spark, folder), batch, COMMERCE, params))


def coverage_link_visit(spark, folder):
    graph, batch = graph_of(spark, folder), chain_batch(spark, THREE)
    params = PARAMS.with_(max_hops=None)
    answers, _ = Workspace(spark, "links").save(batch_star_query(graph, batch, COMMERCE, params), "answers")
    visit, _ = link_visit(graph, batch, answers, COMMERCE, params.with_(stop="coverage"))
    return _visit_rows(visit)


def removed_edges_query(spark, folder):
    sold = spark.read.parquet(f"{folder}/lineitem.parquet").filter("l_returnflag = 'R'")
    part, supplier = F.col("l_partkey"), F.col("l_suppkey") + ID_SPAN
    pairs = sold.select(part.alias("src"), supplier.alias("dst")).union(sold.select(supplier, part))
    graph = remove_edges(graph_of(spark, folder), pairs)
    return _answers(batch_star_query(graph, chain_batch(spark, STAR_ONLY), COMMERCE, PARAMS))


def general_presets(spark, folder):
    return _tuples(run_general_preset(graph_of(spark, folder), "commerce", PARAMS))


def written_tuples(spark, folder):
    """Written twice to one folder: the second run takes the place of the first."""
    path = f"{Workspace(spark, 'answers').path}/out"
    rows = general_query(graph_of(spark, folder), chain_batch(spark, TWO), COMMERCE, PARAMS)
    write_answers(rows.limit(1), path)
    write_answers(rows, path)
    return _tuples(spark.read.schema(rows.schema).parquet(path))


def file_workload(spark, folder):
    """Text files to written answers: the graph and the queries are read back from lines."""
    root, graph = Workspace(spark, "files").path, graph_of(spark, folder)
    edges = graph.edges.select(F.concat_ws("\t", "src", "dst", _label(F.col("level"))))
    nodes = graph.nodes.select(F.concat_ws("\t", F.concat("name", F.lit("+++"), F.col("type_id").cast("string")), "node_id"))
    lines = [
        "\t".join(";".join([*(f"{i},{t}" for i, t in seeds), str(dst)]) for seeds, dst in chain)
        for chain in (C1, C2, C3)
    ]
    # Compressed files cannot be split, so that each has as many lines as a task can take a few of.
    for lines_of, name in ((edges, "edges"), (nodes, "nodes")):
        packed = lines_of.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
        packed.option("maxRecordsPerFile", FILE_LINES).text(f"{root}/{name}")
    spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.text(f"{root}/queries")
    read = build_graph(read_node_info(spark, f"{root}/nodes"), read_edge_list(spark, f"{root}/edges"))
    batch = Batch(*read_queries(spark, f"{root}/queries"))
    rows = run_workload(lay_out(read), batch, COMMERCE, PARAMS)
    write_answers(rows, f"{root}/answers")
    return _tuples(spark.read.schema(rows.schema).parquet(f"{root}/answers"))


def decompose_query(spark, folder):
    """One query graph per customer: who lives in the nation, and what did they order."""
    customer = spark.read.parquet(f"{folder}/customer.parquet")
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    query = customer.select(F.col("c_custkey").alias("query_id"), "c_nationkey")
    unknowns = query.select(
        "query_id",
        F.inline(
            F.array(
                F.struct(F.lit(100).alias("unknown_id"), F.lit(3).alias("dst_type")),
                F.struct(F.lit(50).alias("unknown_id"), F.lit(0).alias("dst_type")),
            )
        ),
    )
    known = query.select(
        "query_id",
        F.lit(100).alias("unknown_id"),
        (F.col("c_nationkey") + 5 * ID_SPAN).alias("seed_id"),
        F.lit(5).alias("seed_type"),
    ).unionByName(
        orders.select(
            F.col("o_custkey").alias("query_id"),
            F.lit(50).alias("unknown_id"),
            (F.col("o_orderkey") + 4 * ID_SPAN).alias("seed_id"),
            F.lit(4).alias("seed_type"),
        )
    )
    chain = query.select("query_id", F.lit(100).alias("unknown_id"), F.lit(50).alias("next_id"))
    batch = decompose(unknowns, known, chain)
    return batch.seeds.join(batch.stars, STAR)


# --- sinks ---------------------------------------------------------------------------


def written_answers(spark, folder):
    path = f"{Workspace(spark, 'answers').path}/out"
    rows = _star(spark, folder)
    write_answers(rows, path, files=1)
    return spark.read.schema(rows.schema).parquet(path)


def run_metrics(spark, folder):
    path = f"{Workspace(spark, 'metrics').path}/out"
    started = time.time()
    rows = _star(spark, folder).count()
    write_run_metrics(spark, path, "star", K, int((time.time() - started) * 1000))
    record = spark.read.parquet(path)
    return record.select("query", "k", (F.col("runtime_ms") >= 0).alias("timed"), F.lit(rows).cast("bigint").alias("n_answers"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "graph_nodes": graph_nodes,
    "graph_edges": graph_edges,
    "graph_stats": graph_counts,
    "type_counts": type_sizes,
    "implicit_nodes": implicit_nodes,
    "edge_dedup": edge_dedup,
    "triplets": triplet_view,
    "type_names": type_names,
    "property_graph": property_graph,
    "graph_fraction": fraction_edges,
    "graph_fraction_nodes": fraction_nodes,
    "remove_edges": removed_edges,
    "lookup_nodes": looked_up_nodes,
    "inherit_pairs": inherit_pairs,
    "parse_edge_lines": edge_lines,
    "parse_node_lines": node_lines,
    "parse_node_table_lines": node_table_lines,
    "parse_adjacency": adjacency_edges,
    "parse_adjacency_nodes": adjacency_nodes,
    "parse_query_lines": query_line_seeds,
    "parse_query_line_stars": query_line_stars,
    "parse_star_sets": star_set_seeds,
    "pick_seeds": picked_seeds,
    "propagate_one_hop": propagate_one_hop,
    "star_visit": visit_rows,
    "visited_any": visited_nodes,
    "candidates": candidate_nodes,
    "star_query": named_star_query,
    "star_query_no_hierarchy": lambda s, f: _star(s, f, hierarchy=False),
    "star_query_early_stop": lambda s, f: _star(s, f, early_stop=True, max_hops=None),
    "star_query_early_stop_bounded": lambda s, f: _star(s, f, THREE, early_stop=True),
    "star_query_pruned": lambda s, f: _star(s, f, THREE, prune="bound"),
    "star_query_coverage": lambda s, f: _star(s, f, THREE, stop="coverage"),
    "star_query_fixpoint": lambda s, f: _star(s, f, max_hops=None),
    "star_details": star_details,
    "compare_hierarchy": hierarchy_on_off,
    "batch_star_query": lambda s, f: _star(s, f, WORKLOAD),
    "nation_workload": nation_workload,
    "nation_chains": nation_chains,
    "top_k_sweep": k_sweep,
    "link_candidates": lambda s, f: _links(s, f),
    "link_candidates_pruned": lambda s, f: _links(s, f, prune="bound"),
    "link_candidates_coverage": lambda s, f: _links(s, f, stop="coverage"),
    "chain_single": lambda s, f: _chain(s, f, STAR_ONLY),
    "chain_two": lambda s, f: _chain(s, f, TWO),
    "chain_three": lambda s, f: _chain(s, f, THREE),
    "chain_three_star_k": lambda s, f: _chain(s, f, THREE, star_k=12),
    "answer_paths": found_paths,
    "shortest_path": path_between,
    "run_workload": workload,
    "chain_k_sweep": chain_sweep,
    "size_sweep": graph_size_sweep,
    "decompose_query": decompose_query,
    "write_read_answers": written_answers,
    "run_metrics": run_metrics,
    "star_visit_coverage": coverage_visit,
    "star_visit_pruned": pruned_visit,
    "link_visit_coverage": coverage_link_visit,
    "link_candidates_pruned_deep": lambda s, f: _links(s, f, prune="bound", max_hops=4),
    "chain_two_star_k": lambda s, f: _chain(s, f, DEEP, star_k=12),
    "chain_three_fixpoint": lambda s, f: _chain(s, f, THREE, max_hops=None),
    "star_query_repeated_seed": lambda s, f: _star(s, f, REPEATED),
    "star_query_removed_edges": removed_edges_query,
    "general_presets": general_presets,
    "write_tuples_twice": written_tuples,
    "file_workload": file_workload,
    "shortest_path_unbounded": lambda s, f: path_between(s, f, None),
    "star_visit_pruned_unbounded": lambda s, f: pruned_visit(s, f, None),
    "link_candidates_pruned_unbounded": lambda s, f: _links(s, f, prune="bound", max_hops=None),
    "visit_metrics": hop_metrics,
    "preview": previewed,
    "adjacency_file_query": adjacency_file_query,
}


def _star_answers_sql(chains=STAR_ONLY, hops=HOPS, **options) -> str:
    return o.star_sql(chains, hops, K, f"SELECT {o.ANSWER_COLUMNS} FROM answers", **options)


def _links_sql(hops=HOPS, **options) -> str:
    ctes = o.graph_ctes() + o.query_ctes(THREE) + o.visit_ctes(hops, **options) + o.answer_ctes(K)
    ctes += o.link_ctes(hops, K, **options)
    return f"""{o._with(ctes)}
SELECT query_id, star_id, source_id, target_id, ROUND(closeness, 6) AS closeness,
       ROUND(pair_score, 6) AS pair_score FROM l_pairs"""


def _link_visit_sql(hops, **options) -> str:
    ctes = o.graph_ctes() + o.query_ctes(THREE) + o.visit_ctes(hops) + o.answer_ctes(K)
    ctes += o.link_ctes(hops, K, **options)
    return f"{o._with(ctes)}\nSELECT {o.VISIT_COLUMNS} FROM l_visit"


def _removed_sql() -> str:
    sold = "SELECT 1 FROM lineitem WHERE l_returnflag = 'R'"
    left = f"""SELECT * FROM all_edges e WHERE NOT EXISTS ({sold} AND l_partkey = e.src AND l_suppkey + 1000000000 = e.dst)
    AND NOT EXISTS ({sold} AND l_partkey = e.dst AND l_suppkey + 1000000000 = e.src)"""
    nodes, one_way, edges = o.graph_ctes()
    ctes = [nodes, one_way, edges.replace("edges AS", "all_edges AS", 1), f"edges AS MATERIALIZED ({left})"]
    ctes += o.query_ctes(STAR_ONLY) + o.visit_ctes(HOPS) + o.answer_ctes(K)
    return f"{o._with(ctes)}\nSELECT {o.ANSWER_COLUMNS} FROM answers"


def _nation_ctes(chain: bool) -> list[str]:
    seeds = """
  SELECT n_nationkey::BIGINT AS query_id, 0 AS star_id, 5000000000 + n_nationkey AS seed_id, 5 AS seed_type FROM nation
  UNION ALL SELECT n_nationkey::BIGINT, 0, 2000000001 + n_nationkey, 2 FROM nation"""
    stars = "SELECT n_nationkey::BIGINT AS query_id, 0 AS star_id, 0 AS dst_type FROM nation"
    if chain:
        seeds += " UNION ALL SELECT n_nationkey::BIGINT, 1, 6000000000 + n_regionkey, 6 FROM nation"
        stars += " UNION ALL SELECT n_nationkey::BIGINT, 1, 3 FROM nation"
    return [f"seeds AS ({seeds})", f"stars AS ({stars})"]


def _nation_sql() -> str:
    ctes = o.graph_ctes() + _nation_ctes(False) + o.visit_ctes(HOPS) + o.answer_ctes(K)
    return f"{o._with(ctes)}\nSELECT {o.ANSWER_COLUMNS} FROM answers"


def _compare_sql() -> str:
    ctes = o.graph_ctes()
    for p, flag in (("a_", True), ("b_", False)):
        ctes += o.query_ctes(STAR_ONLY, p) + o.visit_ctes(HOPS, p, hierarchy=flag) + o.answer_ctes(K, p)
    return f"""{o._with(ctes)}
SELECT COALESCE(a.query_id, b.query_id) AS query_id, COALESCE(a.star_id, b.star_id) AS star_id,
       COALESCE(a.node_id, b.node_id) AS node_id, a.rank AS rank_on, ROUND(a.score, 6) AS score_on,
       b.rank AS rank_off, ROUND(b.score, 6) AS score_off
FROM a_answers a FULL JOIN b_answers b
  ON a.query_id = b.query_id AND a.star_id = b.star_id AND a.node_id = b.node_id"""


def _k_sweep_sql() -> str:
    return o.star_sql(
        STAR_ONLY,
        HOPS,
        30,
        """SELECT s.k, a.query_id, a.rank, a.node_id, ROUND(a.score, 6) AS score
FROM answers a JOIN (VALUES (1), (2), (5), (10), (15), (20), (25), (30)) s(k) ON a.rank <= s.k""",
    )


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


SEED_LINES = """
SELECT l_orderkey * 10 + l_linenumber AS query_id, 0 AS star_id, l_partkey AS seed_id, 0 AS seed_type FROM lineitem
UNION ALL SELECT l_orderkey * 10 + l_linenumber, 0, l_suppkey, 1 FROM lineitem
UNION ALL SELECT l_orderkey * 10 + l_linenumber, 1, l_orderkey, 4 FROM lineitem"""

ORACLE: dict[str, str] = {
    "graph_nodes": o.graph_sql("SELECT *, FALSE AS implicit FROM nodes"),
    "graph_edges": o.graph_sql(
        "SELECT e.*, n.type_id AS dst_type FROM edges e JOIN nodes n ON n.node_id = e.dst"
    ),
    "graph_stats": o.graph_sql(
        "SELECT (SELECT COUNT(*) FROM nodes) AS n_nodes, 0::BIGINT AS n_implicit,"
        " (SELECT COUNT(*) FROM edges) AS n_edges"
    ),
    "type_counts": o.graph_sql("SELECT type_id, COUNT(*) AS n_nodes FROM nodes GROUP BY type_id"),
    "implicit_nodes": "SELECT DISTINCT 1000000000 + k AS node_id, 0 AS type_id FROM"
    " (SELECT l_suppkey AS k FROM lineitem UNION SELECT s_suppkey FROM supplier)",
    "edge_dedup": """SELECT src, dst, CASE WHEN up THEN 1 WHEN down THEN -1 ELSE 0 END AS level FROM (
  SELECT l_partkey AS src, l_suppkey AS dst, BOOL_OR(l_returnflag = 'R') AS up,
         BOOL_OR(l_returnflag = 'A') AS down FROM lineitem GROUP BY l_partkey, l_suppkey)""",
    "triplets": o.graph_sql(
        """SELECT e.src, s.type_id AS src_type, s.name AS src_name, e.level, e.dst,
       d.type_id AS dst_type, d.name AS dst_name
FROM edges e JOIN nodes s ON s.node_id = e.src JOIN nodes d ON d.node_id = e.dst"""
    ),
    "type_names": o.graph_sql(
        f"SELECT node_id, type_id, type_name FROM nodes JOIN {o.TYPES} t(tid, type_name) ON type_id = tid"
    ),
    "property_graph": """WITH ids AS (
  SELECT id, DENSE_RANK() OVER (ORDER BY id) AS n
  FROM (SELECT c_name AS id FROM customer UNION SELECT n_name FROM nation))
SELECT c_name AS src, n_name AS dst, 'lives_in' AS relationship, a.n AS src_id, b.n AS dst_id
FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN ids a ON a.id = c_name JOIN ids b ON b.id = n_name""",
    "graph_fraction": o.graph_sql("SELECT src, dst, level FROM edges", o.fraction(0.5)),
    "graph_fraction_nodes": o.graph_sql("SELECT node_id, type_id FROM nodes", o.fraction(0.2)),
    "remove_edges": o.graph_sql(
        """SELECT src, dst, level FROM edges e WHERE NOT EXISTS (
  SELECT 1 FROM lineitem WHERE l_returnflag = 'R' AND l_partkey = e.src AND l_orderkey + 4000000000 = e.dst)"""
    ),
    "lookup_nodes": o.graph_sql(
        "SELECT node_id, type_id, name FROM nodes WHERE node_id IN"
        " (SELECT 1000000000 + l_suppkey FROM lineitem WHERE l_returnflag = 'R')"
    ),
    "inherit_pairs": f"SELECT a AS type_a, b AS type_b FROM {o.TYPES} x(a, an), {o.TYPES} y(b, bn)"
    f" WHERE {o.inherit_rule('a', 'b')}",
    "parse_edge_lines": o.graph_sql("SELECT src, dst, level FROM edges"),
    "parse_node_lines": o.graph_sql(
        "SELECT node_id, type_id, name, '\"' || name || '+++ ' || type_id || '\"' AS raw_name FROM nodes"
    ),
    "parse_node_table_lines": o.graph_sql("SELECT node_id, type_id, name FROM nodes"),
    "parse_adjacency": """
SELECT l_orderkey AS src, l_partkey AS dst, 1 AS level FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 1 FROM lineitem
UNION ALL SELECT l_orderkey, l_suppkey, -1 FROM lineitem
UNION ALL SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN l_partkey ELSE -10001 END, 0 FROM lineitem""",
    "parse_adjacency_nodes": "SELECT l_orderkey AS node_id, 4 AS type_id FROM lineitem",
    "parse_query_lines": SEED_LINES,
    "parse_query_line_stars": """
SELECT l_orderkey * 10 + l_linenumber AS query_id, 0 AS star_id, 3 AS dst_type FROM lineitem
UNION ALL SELECT l_orderkey * 10 + l_linenumber, 1, 0 FROM lineitem""",
    "parse_star_sets": SEED_LINES,
    "pick_seeds": o.graph_sql(
        """SELECT node_id AS seed_id, type_id AS seed_type FROM (
  SELECT *, ROW_NUMBER() OVER (ORDER BY node_id) - 1 AS place FROM nodes WHERE type_id IN (1, 4, 5, 6))
WHERE place % 10 = 0 AND place BETWEEN 10 AND 500"""
    ),
    "propagate_one_hop": o.star_sql(STAR_ONLY, 1, K, f"SELECT {o.VISIT_COLUMNS} FROM visit"),
    "star_visit": o.star_sql(STAR_ONLY, HOPS, K, f"SELECT {o.VISIT_COLUMNS} FROM visit"),
    "visited_any": o.star_sql(STAR_ONLY, HOPS, K, "SELECT DISTINCT query_id, star_id, node_id FROM visit"),
    "candidates": o.star_sql(
        STAR_ONLY,
        HOPS,
        K,
        """SELECT query_id, star_id, node_id, type_id, ROUND(score, 6) AS score,
       ROUND(lower_bound, 6) AS lower_bound, ROUND(lower_bound, 6) AS upper_bound FROM cand""",
    ),
    "star_query": o.star_sql(
        STAR_ONLY,
        HOPS,
        K,
        "SELECT rank, a.node_id, n.name, ROUND(score, 6) AS score"
        " FROM answers a JOIN nodes n ON n.node_id = a.node_id",
    ),
    "star_query_no_hierarchy": _star_answers_sql(hierarchy=False),
    "star_query_early_stop": _star_answers_sql(hops=8),
    "star_query_early_stop_bounded": _star_answers_sql(THREE),
    "star_query_pruned": _star_answers_sql(THREE, prune_k=K),
    "star_query_coverage": _star_answers_sql(THREE, coverage=True),
    "star_query_fixpoint": _star_answers_sql(hops=8),
    "star_details": o.star_sql(
        STAR_ONLY,
        HOPS,
        K,
        """SELECT a.rank, a.node_id, v.seed_id, v.dist, v.n_paths, ROUND(v.closeness, 6) AS closeness,
       ROUND(v.lb, 6) AS lower_bound, v.parent_id
FROM answers a JOIN visit v ON v.query_id = a.query_id AND v.star_id = a.star_id AND v.node_id = a.node_id""",
    ),
    "compare_hierarchy": _compare_sql(),
    "batch_star_query": _star_answers_sql(WORKLOAD),
    "nation_workload": _nation_sql(),
    "nation_chains": o.chain_sql(TWO, HOPS, K, queries=_nation_ctes(True)),
    "top_k_sweep": _k_sweep_sql(),
    "link_candidates": _links_sql(),
    "link_candidates_pruned": _links_sql(prune_k=K),
    "link_candidates_coverage": _links_sql(coverage=True),
    "chain_single": o.chain_sql(STAR_ONLY, HOPS, K),
    "chain_two": o.chain_sql(TWO, HOPS, K),
    "chain_three": o.chain_sql(THREE, HOPS, K),
    "chain_three_star_k": o.chain_sql(THREE, HOPS, K, star_k=12),
    "answer_paths": o.path_sql(STAR_ONLY, HOPS, K),
    "shortest_path": o.shortest_path_sql(*PATH_ENDS, 6),
    "run_workload": o.chain_sql(WORKLOAD, HOPS, K),
    "chain_k_sweep": _union([o.chain_sql(TWO, HOPS, k, extra=f"{k} AS k, ") for k in SWEEP_K]),
    "size_sweep": _union(
        [
            o.chain_sql(
                size_chains(r),
                SIZE_HOPS,
                K,
                extra=f"{r}::DOUBLE AS ratio, ",
                keep=o.fraction(r) if r < 1 else None,
            )
            for r in SWEEP_RATIOS
        ]
    ),
    "decompose_query": """
SELECT c_custkey AS query_id, 0 AS star_id, 5000000000 + c_nationkey AS seed_id, 5 AS seed_type, 3 AS dst_type
FROM customer
UNION ALL SELECT o_custkey, 1, 4000000000 + o_orderkey, 4, 0 FROM orders""",
    "write_read_answers": _star_answers_sql(),
    "run_metrics": o.star_sql(
        STAR_ONLY,
        HOPS,
        K,
        f"SELECT 'star' AS query, {K} AS k, TRUE AS timed, COUNT(*)::BIGINT AS n_answers FROM answers",
    ),
    "star_visit_coverage": o.star_sql(THREE, 8, K, f"SELECT {o.VISIT_COLUMNS} FROM visit", coverage=True),
    "star_visit_pruned": o.star_sql(THREE, HOPS, K, f"SELECT {o.VISIT_COLUMNS} FROM visit", prune_k=K),
    "link_visit_coverage": _link_visit_sql(8, coverage=True),
    "link_candidates_pruned_deep": _links_sql(4, prune_k=K),
    "chain_two_star_k": o.chain_sql(DEEP, HOPS, K, star_k=12),
    "chain_three_fixpoint": o.chain_sql(THREE, 8, K),
    "star_query_repeated_seed": _star_answers_sql(),
    "star_query_removed_edges": _removed_sql(),
    "general_presets": _union([o.chain_sql(PRESET_CHAINS, HOPS, k, extra=f"{k} AS k, ") for k in (2, 5, 10)]),
    "write_tuples_twice": o.chain_sql(TWO, HOPS, K),
    "file_workload": o.chain_sql({i: c for i, c in enumerate((C1, C2, C3))}, HOPS, K),
    "shortest_path_unbounded": o.shortest_path_sql(*PATH_ENDS, 8),
    "star_visit_pruned_unbounded": o.star_sql(THREE, 8, K, f"SELECT {o.VISIT_COLUMNS} FROM visit", prune_k=K),
    "link_candidates_pruned_unbounded": _links_sql(8, prune_k=K),
    "visit_metrics": o.star_sql(
        STAR_ONLY, HOPS, K, "SELECT dist AS hop, COUNT(*)::BIGINT AS new_pairs FROM visit GROUP BY dist"
    ),
    "preview": o.graph_sql(
        """SELECT e.src, s.type_id AS src_type, s.name AS src_name, e.level, e.dst,
       d.type_id AS dst_type, d.name AS dst_name
FROM edges e JOIN nodes s ON s.node_id = e.src JOIN nodes d ON d.node_id = e.dst ORDER BY e.src, e.dst LIMIT 5"""
    ),
    "adjacency_file_query": _star_answers_sql(),
}
