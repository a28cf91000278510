"""Scoring model as Column expressions; everything stays in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierwalk.params import Domain, ScoreParams


def edge_level(label: Column) -> Column:
    """Level of an edge label: same 0, higher 1, anything else -1."""
    return F.when(label == "same", F.lit(0)).when(label == "higher", F.lit(1)).otherwise(F.lit(-1))


def edge_weight(level: Column, params: ScoreParams) -> Column:
    """Discount an edge gives back along the hierarchy; the direction does not matter."""
    return F.lit(params.beta) * F.abs(level)


def closeness(
    dist: Column, n_paths: Column, parent_hier: Column, hier: Column, params: ScoreParams
) -> Column:
    """Closeness of a node to a seed: decays with distance, grows with shortest paths."""
    alpha = F.lit(params.alpha)
    return F.least(
        F.lit(params.norm) * F.pow(alpha, dist - parent_hier),
        n_paths * F.pow(alpha, dist - hier),
    )


def lower_bound(
    previous: Column,
    dist: Column,
    parent_hier: Column,
    parents_bound: Column,
    max_edge: Column,
    params: ScoreParams,
) -> Column:
    """Lower bound of a closeness from the summed bounds of the parents.

    Along hierarchy edges without inheritance it can exceed the closeness: the edge
    discount counts here even where it does not count in the score.
    """
    alpha = F.lit(params.alpha)
    fresh = F.least(
        F.lit(params.norm) * F.pow(alpha, dist - parent_hier),
        F.pow(alpha, F.lit(1.0) - max_edge) * parents_bound,
    )
    return F.when(previous > 0, previous).otherwise(fresh)


def upper_bound(bound: Column, dist: Column, hier: Column, params: ScoreParams) -> Column:
    """Upper bound of a visited pair: its lower bound once that is known."""
    return F.when(bound > 0, bound).otherwise(F.pow(F.lit(params.alpha), dist - hier))


def unvisited_cap(hop: Column, inherit: Column, params: ScoreParams) -> Column:
    """Most that a pair not visited by ``hop`` can still score (for levels -1, 0, 1)."""
    ahead = hop + F.lit(1)
    exponent = F.when(inherit, (1.0 - params.beta) * ahead + params.beta).otherwise(ahead)
    return F.lit(params.norm) * F.pow(F.lit(params.alpha), exponent.cast("double"))


def inherits(type_a: Column, type_b: Column, domain: Domain, hierarchy: bool = True) -> Column:
    """Whether the two types stand in an inheritance pair of the domain."""
    if not hierarchy or not domain.rules:
        return F.lit(False)

    def holds(rule):
        first, second = rule
        if second is None:
            return (type_a == first) | (type_b == first)
        return ((type_a == first) & (type_b == second)) | ((type_a == second) & (type_b == first))

    return F.coalesce(reduce(lambda x, y: x | y, map(holds, domain.rules)), F.lit(False))
