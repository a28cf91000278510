"""Query tables: query_seeds(query_id, star_id, seed_id, seed_type) and
query_stars(query_id, star_id, dst_type). One query is a batch of one."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED_COLUMNS = {"query_id": pa.int64(), "star_id": pa.int32(), "seed_id": pa.int64(), "seed_type": pa.int32()}
STAR_COLUMNS = {"query_id": pa.int64(), "star_id": pa.int32(), "dst_type": pa.int32()}

Seeds = list[tuple[int, int]]
Star = tuple[Seeds, int]


@dataclass(frozen=True)
class Batch:
    seeds: DataFrame
    stars: DataFrame

    def union(self, other: "Batch") -> "Batch":
        return Batch(self.seeds.unionByName(other.seeds), self.stars.unionByName(other.stars))


def small_table(spark: SparkSession, columns: dict[str, pa.DataType], rows: list[tuple]) -> DataFrame:
    """A few literal rows as a local relation, whose size the planner knows."""
    values = list(zip(*rows)) if rows else [()] * len(columns)
    arrays = [pa.array(v, kind) for v, kind in zip(values, columns.values())]
    return spark.createDataFrame(pa.table(arrays, names=list(columns)))


def chain_batch(spark: SparkSession, chains: dict[int, list[Star]]) -> Batch:
    """Chains by query id; a chain is a list of (seeds, wanted type), first unknown first."""
    seeds, stars = [], []
    for query_id, chain in chains.items():
        for star_id, (star_seeds, dst_type) in enumerate(chain):
            stars.append((query_id, star_id, dst_type))
            seeds.extend((query_id, star_id, seed, kind) for seed, kind in star_seeds)
    return Batch(small_table(spark, SEED_COLUMNS, seeds), small_table(spark, STAR_COLUMNS, stars))


def star_batch(spark: SparkSession, seeds: Seeds, dst_type: int, query_id: int = 1) -> Batch:
    return chain_batch(spark, {query_id: [(seeds, dst_type)]})


def with_wanted_type(seeds: DataFrame, dst_type: int) -> Batch:
    """A batch from star sets, with one wanted type for all stars."""
    stars = seeds.select("query_id", "star_id").distinct()
    return Batch(seeds, stars.withColumn("dst_type", F.lit(dst_type)))
