"""The order tables as a typed graph: parts, suppliers, brands, customers, orders, places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwalk.operators.graph import Graph, build_graph
from tierwalk.params import COMMERCE

ID_SPAN = 1_000_000_000


def _node_id(type_name: str, key: Column) -> Column:
    return (F.lit(COMMERCE.type_id(type_name)).cast("bigint") * ID_SPAN + key).cast("bigint")


def _brand(brand: str) -> Column:
    return F.substring_index(F.col(brand), "#", -1).cast("bigint")


def commerce_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """nodes(node_id, type_id, name) and edges(src, dst, level), each edge both ways."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    def nodes(rows: DataFrame, type_name: str, key: Column, name: Column) -> DataFrame:
        return rows.select(
            _node_id(type_name, key).alias("node_id"),
            F.lit(COMMERCE.type_id(type_name)).alias("type_id"),
            name.alias("name"),
        )

    def arcs(rows: DataFrame, a: str, a_key: Column, b: str, b_key: Column, level: int) -> DataFrame:
        return rows.select(
            _node_id(a, a_key).alias("src"), _node_id(b, b_key).alias("dst"), F.lit(level).alias("level")
        )

    part, supplier, customer = table("part"), table("supplier"), table("customer")
    orders, nation, region = table("orders"), table("nation"), table("region")
    sold = table("lineitem")
    c = F.col

    all_nodes = reduce(
        DataFrame.unionByName,
        [
            nodes(part, "PART", c("p_partkey"), c("p_name")),
            nodes(supplier, "SUPPLIER", c("s_suppkey"), c("s_name")),
            nodes(part.select("p_brand").distinct(), "BRAND", _brand("p_brand"), c("p_brand")),
            nodes(customer, "CUSTOMER", c("c_custkey"), c("c_name")),
            nodes(orders, "ORDER", c("o_orderkey"), F.concat(F.lit("ORDER_"), c("o_orderkey"))),
            nodes(nation, "NATION", c("n_nationkey"), c("n_name")),
            nodes(region, "REGION", c("r_regionkey"), c("r_name")),
        ],
    )
    part_supplier = sold.select("l_partkey", "l_suppkey").distinct()
    part_order = sold.select("l_partkey", "l_orderkey").distinct()
    one_way = reduce(
        DataFrame.unionByName,
        [
            arcs(part, "PART", c("p_partkey"), "BRAND", _brand("p_brand"), 1),
            arcs(part_supplier, "PART", c("l_partkey"), "SUPPLIER", c("l_suppkey"), 0),
            arcs(part_order, "PART", c("l_partkey"), "ORDER", c("l_orderkey"), 0),
            arcs(orders, "ORDER", c("o_orderkey"), "CUSTOMER", c("o_custkey"), 0),
            arcs(customer, "CUSTOMER", c("c_custkey"), "NATION", c("c_nationkey"), 1),
            arcs(supplier, "SUPPLIER", c("s_suppkey"), "NATION", c("s_nationkey"), 1),
            arcs(nation, "NATION", c("n_nationkey"), "REGION", c("n_regionkey"), 1),
        ],
    )
    # Both directions from one pass over the tables.
    both = F.array(
        F.struct("src", "dst", "level"),
        F.struct(c("dst").alias("src"), c("src").alias("dst"), (-c("level")).alias("level")),
    )
    return all_nodes, one_way.select(F.inline(both))


def commerce_graph(spark: SparkSession, folder: str) -> Graph:
    nodes, edges = commerce_tables(spark, folder)
    return build_graph(nodes, edges, default_type=0, distinct_edges=True)
