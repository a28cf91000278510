from tierwalk.sources.commerce import commerce_graph, commerce_tables
from tierwalk.sources.text import (
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

__all__ = [
    "commerce_graph",
    "commerce_tables",
    "parse_adjacency",
    "parse_edge_lines",
    "parse_node_lines",
    "parse_node_table_lines",
    "parse_query_lines",
    "parse_star_sets",
    "pick_seeds",
    "read_adjacency",
    "read_edge_list",
    "read_node_info",
    "read_node_table",
    "read_queries",
    "read_star_sets",
]
