"""Entry points of the known domains: fixed seeds and wanted types, and for general queries k."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tierwalk.operators.batch import Star, chain_batch
from tierwalk.operators.graph import Graph
from tierwalk.operators.star import star_query
from tierwalk.params import BIBLIOGRAPHY, COMMERCE, PRODUCT, SYNTHETIC, Domain, ScoreParams
from tierwalk.plans.workload import chain_k_sweep


@dataclass(frozen=True)
class Preset:
    domain: Domain
    seeds: tuple[tuple[int, int], ...]
    dst_type: int


@dataclass(frozen=True)
class GeneralPreset:
    """Chains asked of a domain, by query id, for each of several k."""

    domain: Domain
    chains: dict[int, list[Star]]
    ks: tuple[int, ...] = (2, 5, 10)


# The seed nodes (id, type) and wanted types of the experiments.
PRESETS = {
    "product": Preset(PRODUCT, ((2020, 1), (9021, 4)), 0),
    "bibliography": Preset(BIBLIOGRAPHY, ((188421, 3), (162877, 1)), 1),
    "synthetic": Preset(SYNTHETIC, ((695138, 2), (655399, 2), (621354, 2)), 0),
    "synthetic_tiny": Preset(SYNTHETIC, ((1, 2), (2, 2)), 0),
}


_PART: Star = ([(2000000002, 2), (3000000007, 3), (1000000003, 1)], 0)
_CUSTOMER: Star = ([(5000000001, 5), (4000000010, 4)], 3)

GENERAL_PRESETS = {
    "commerce": GeneralPreset(COMMERCE, {1: [_PART], 2: [_PART, _CUSTOMER]}),
}


def run_general_preset(graph: Graph, name: str, params: ScoreParams) -> DataFrame:
    """Answers of every chain of a domain for each of its k."""
    preset = GENERAL_PRESETS[name]
    batch = chain_batch(graph.spark, preset.chains)
    return chain_k_sweep(graph, batch, preset.domain, params, preset.ks)


def run_preset(graph: Graph, name: str, params: ScoreParams) -> DataFrame:
    preset = PRESETS[name]
    return star_query(graph, list(preset.seeds), preset.dst_type, preset.domain, params)
