"""Top-k queries over typed graphs with hierarchy levels, on Spark DataFrames."""

from tierwalk.operators.batch import Batch, chain_batch, star_batch, with_wanted_type
from tierwalk.operators.chain import general_query, link_candidates
from tierwalk.operators.graph import (
    Graph,
    build_graph,
    build_property_graph,
    close_graph,
    graph_fraction,
    graph_stats,
    lay_out,
    lookup_nodes,
    open_graph,
    preview,
    remove_edges,
    triplets,
    with_names,
    with_type_names,
)
from tierwalk.operators.paths import answer_paths, shortest_path
from tierwalk.operators.star import (
    answer_details,
    batch_star_query,
    candidates,
    compare_hierarchy,
    score_nodes,
    star_answers,
    star_query,
)
from tierwalk.operators.visit import star_visit, visited_any
from tierwalk.params import DOMAINS, Domain, ScoreParams

__all__ = [
    "DOMAINS",
    "Batch",
    "Domain",
    "Graph",
    "ScoreParams",
    "answer_details",
    "answer_paths",
    "batch_star_query",
    "build_graph",
    "build_property_graph",
    "candidates",
    "chain_batch",
    "close_graph",
    "compare_hierarchy",
    "general_query",
    "graph_fraction",
    "graph_stats",
    "lay_out",
    "link_candidates",
    "lookup_nodes",
    "open_graph",
    "preview",
    "remove_edges",
    "score_nodes",
    "shortest_path",
    "star_answers",
    "star_batch",
    "star_query",
    "star_visit",
    "triplets",
    "visited_any",
    "with_names",
    "with_type_names",
    "with_wanted_type",
]
