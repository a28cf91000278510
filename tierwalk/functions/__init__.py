from tierwalk.functions.scoring import (
    closeness,
    edge_level,
    edge_weight,
    inherits,
    lower_bound,
    unvisited_cap,
    upper_bound,
)

__all__ = [
    "closeness",
    "edge_level",
    "edge_weight",
    "inherits",
    "lower_bound",
    "unvisited_cap",
    "upper_bound",
]
