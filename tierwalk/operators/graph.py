"""Graph assembly, layout on storage, views, filters and counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierwalk.params import Domain
from tierwalk.workspace import WRITERS, Workspace, setting, shuffles_removed

# A source with more edges than this is cut into pieces.
PIECE_ROWS = 1_000_000
# What a task of a walk holds grows with its bucket: a few walks over this many edges fit a task without spilling.
BUCKET_ROWS = 1_000_000
# A literal list of this many ids becomes exact row group tests in the parquet reader.
ROW_GROUP_IDS = 10
# A literal list of up to this many ids selects their buckets of a laid out graph.
BUCKET_IDS = 2_000
# Tables of up to this many rows (well under 100 MB) are broadcast.
BROADCAST_ROWS = 200_000
# Cells of a hash in which sources are counted, to find those that can be hubs.
CELLS = 10_007
# Row groups of a nested layout; a fraction reads those that begin within it.
NESTED_BYTES = 16 << 20
# Nodes of a task, as shuffled, up to which edges meet them in a hash table; not under Spark's advisory size of a partition.
HASH_BYTES = "64m"
# Spark's own limit.
MAX_BUCKETS = 100_000
# With the piece size also at least total / MAX_HUBS, which is a bucket's share of the largest graphs, no more
# sources than this can exceed it: the bound that makes the table of hubs safe to broadcast.
MAX_HUBS = MAX_BUCKETS


@dataclass(frozen=True)
class Graph:
    """nodes(node_id, type_id, name, raw_name, implicit) and edges(src, dst, level, dst_type).

    ``declared`` are the nodes that were given, as against those only seen in edges; it
    serves the layout, which completes them from edges already written. ``marked`` are the edges with a column ``loose``:
    the target is not declared.

    The edges carry the type of their target, so a walk never joins the nodes. A laid
    out graph has its edges in ``buckets`` by source, and its nodes by id. Edges taken out of it stay in the buckets:
    ``stored`` are the edges as they lie, ``removed`` the pairs that do not count, ``edges`` what is left. If some sources are hubs, they are
    bucketed by ``slot``, a hash of source and piece; ``hubs(src, pieces)`` says into
    how many pieces each hub was cut. One bucket column is what lets Spark skip buckets.
    """

    nodes: DataFrame
    edges: DataFrame
    declared: DataFrame | None = None
    default_type: int = 0
    buckets: int | None = None
    hubs: DataFrame | None = None
    hubs_bounded: bool = False
    n_pieces: int = 0
    table: str | None = None
    #: Edges with a level beyond -1 to 1; None if nobody counted.
    odd_levels: int | None = None
    node_table: str | None = None
    stored: DataFrame | None = None
    removed: DataFrame | None = None
    marked: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @property
    def id_limit(self) -> int:
        """Literal ids up to which a scan leaves something unread: only ids fewer than the buckets do."""
        return min(BUCKET_IDS, self.buckets - 1) if self.buckets else ROW_GROUP_IDS

    def edges_where(self, narrow: Callable[[DataFrame], DataFrame]) -> Graph:
        """The graph with fewer edges; they stay in their buckets."""
        stored = None if self.stored is None else narrow(self.stored)
        return replace(self, edges=narrow(self.edges), stored=stored, marked=None)


def few_ids(df: DataFrame, column: str, rows: int, limit: int) -> list[int]:
    """The distinct ids of a table that has at most ``limit`` rows, else none."""
    if rows > limit:
        return []
    ids = [r[0] for r in df.select(column).distinct().limit(limit + 1).collect()]
    return ids if len(ids) <= limit else []


def only_ids(df: DataFrame, column: str, ids: list[int]) -> DataFrame:
    """Narrow a scan to the ids, if there are any; the join alone would read it all."""
    return df.filter(F.col(column).isin(*ids)) if ids else df


def _with_columns(nodes: DataFrame) -> DataFrame:
    name = F.col("name") if "name" in nodes.columns else F.lit(None).cast("string")
    raw = F.col("raw_name") if "raw_name" in nodes.columns else name
    return nodes.select(
        F.col("node_id").cast("bigint").alias("node_id"),
        F.col("type_id").cast("int").alias("type_id"),
        name.alias("name"),
        raw.alias("raw_name"),
    )


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One row per (src, dst): the largest absolute level, the positive one on a tie.

    Size and sign are one number, which is aggregated by hashing; a struct would sort all edges before and after the shuffle."""
    level, kind = F.col("level").cast("bigint"), edges.schema["level"].dataType
    strongest = F.max(2 * F.abs(level) + F.when(level > 0, 1).otherwise(0)).alias("strongest")
    size = F.shiftright("strongest", 1)
    signed = F.when(F.col("strongest") % 2 == 1, size).otherwise(-size).cast(kind)
    return edges.groupBy("src", "dst").agg(strongest).select("src", "dst", signed.alias("level"))


def build_graph(
    nodes: DataFrame, edges: DataFrame, default_type: int = 0, distinct_edges: bool = False
) -> Graph:
    """Assemble a graph; edge ends without a node row become nodes of ``default_type``.

    ``distinct_edges`` states that (src, dst) is unique already and saves a shuffle.
    """
    best = F.min(F.struct("type_id", "name", "raw_name"))
    known = (
        _with_columns(nodes)
        .groupBy("node_id")
        .agg(best.alias("n"))
        .select("node_id", "n.type_id", "n.name", "n.raw_name")
    )
    arcs = edges.select(
        F.col("src").cast("bigint").alias("src"),
        F.col("dst").cast("bigint").alias("dst"),
        F.col("level").cast("int").alias("level"),
    )
    if not distinct_edges:
        arcs = dedup_edges(arcs)
    # The type of the least row is the least type, which is aggregated by hashing and without the names; a null goes before any.
    least = F.when(F.bool_or(F.col("type_id").isNull()), None).otherwise(F.min(F.col("type_id").cast("int")))
    types = nodes.groupBy(F.col("node_id").cast("bigint").alias("dst")).agg(least.alias("dst_type"), F.lit(True).alias("found"))
    marked = arcs.join(types, "dst", "left").select(
        "src",
        "dst",
        "level",
        F.coalesce("dst_type", F.lit(default_type)).cast("int").alias("dst_type"),
        F.col("found").isNull().alias("loose"),
    )
    ends = arcs.select(F.col("src").alias("node_id")).union(arcs.select("dst")).distinct()
    nodes = complete_nodes(known, ends, default_type)
    return Graph(nodes, marked.drop("loose"), known, default_type, marked=marked)


def complete_nodes(declared: DataFrame, ends: DataFrame, default_type: int) -> DataFrame:
    """Declared nodes plus the edge ends (node_id) that are not among them."""
    implicit = ends.join(declared, "node_id", "left_anti").select(
        "node_id",
        F.lit(default_type).cast("int").alias("type_id"),
        F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("raw_name"),
        F.lit(True).alias("implicit"),
    )
    return declared.withColumn("implicit", F.lit(False)).unionByName(implicit)


def slot(src: str, piece: Column) -> Column:
    """Bucket key of one piece of a source."""
    return F.xxhash64(src, piece.cast("bigint"))


def crowded(edges: DataFrame, size: int) -> DataFrame:
    """The edges among which every source with more than ``size`` of them is; most others are left out.

    Sources are counted by cells of a hash first, which needs next to no memory and moves nothing to speak of. A cell
    holds at least the edges of any source in it."""
    cell = F.pmod(F.xxhash64("src"), F.lit(CELLS))
    full = edges.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size)
    cells = [r["cell"] for r in full.select("cell").collect()]
    return edges.where(cell.isin(*cells)) if cells else edges.limit(0)


def lay_out(
    graph: Graph, buckets: int | None = None, piece_rows: int | None = None, path: str | None = None, shares: bool = False
) -> Graph:
    """Write the graph once so that no later walk shuffles its edges.

    Edges go to a parquet table bucketed and sorted by source. A source may hold a
    large share of all edges, so hubs are cut into pieces of about ``piece_rows`` edges
    by a hash of the target, and each piece has a bucket key of its own.

    With ``shares`` the layout is nested: edges and nodes carry the share of the graph from which on they belong to
    it, and the edges of a bucket are sorted by it, so that a fraction of the graph is a prefix of every file.

    With ``path`` the layout stays there for ``open_graph``; without, it goes with the
    application. What is written on the way always does.
    """
    spark = graph.spark
    ws = Workspace(spark, "graph")
    root = path or ws.path
    # Written first: counting, cutting and bucketing then read it instead of assembling
    # the edges again.
    facts = ["src", "dst", "level", "dst_type"]
    arcs = graph.edges.select(*facts) if graph.marked is None else graph.marked.select(*facts, "loose")
    if shares:
        arcs = arcs.withColumn("share", F.greatest(_share("src"), _share("dst")))
    # Where the nodes of a task are few, the edges stream past them unsorted.
    with setting(spark, "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", HASH_BYTES):
        written, total, odd_levels = ws.save_counting(arcs, "arcs", ~F.col("level").between(-1, 1))

    bounded = piece_rows is None
    size = piece_rows or max(PIECE_ROWS, -(-total // MAX_HUBS))
    degrees = crowded(written, size).groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    hubs, n_hubs = ws.save(
        degrees.filter(F.col("degree") > size).select(
            "src", F.ceil(F.col("degree") / F.lit(size)).cast("int").alias("pieces")
        ),
        "hubs",
    )
    if path:
        hubs.write.parquet(f"{root}/hubs")
    arcs, key, n_pieces = written.drop("loose"), "src", 0
    if n_hubs:
        n_pieces = hubs.agg(F.sum("pieces")).first()[0]
        side = F.broadcast(hubs) if bounded else hubs
        piece = F.pmod(F.xxhash64("dst"), F.coalesce("pieces", F.lit(1)))
        arcs = arcs.join(side, "src", "left").withColumn("slot", slot("src", piece)).drop("pieces")
        key = "slot"

    if buckets is None:
        cores = spark.sparkContext.defaultParallelism
        buckets = min(MAX_BUCKETS, max(cores, -(-total // BUCKET_ROWS)))
    table = f"tierwalk_edges_{uuid.uuid4().hex}"
    order = ["share", key] if shares else [key]
    writer = arcs.repartition(buckets, key).sortWithinPartitions(*order).write.bucketBy(buckets, key)
    if shares:
        writer = writer.option("parquet.block.size", NESTED_BYTES)
    # A task writes one bucket in the order it is in; a declared order would have every task sort its rows again, by bucket.
    with shuffles_removed(spark), setting(spark, "spark.sql.maxConcurrentOutputFileWriters", WRITERS):
        writer.option("path", f"{root}/edges").format("parquet").saveAsTable(table)
    nodes = graph.nodes
    if graph.declared is not None:
        # Sources are told apart bucket by bucket; of the targets only those without a node row are left to look at.
        loose = written.where("loose") if graph.marked is not None else written
        ends = spark.table(table).select(F.col("src").alias("node_id")).distinct().union(loose.select("dst")).distinct()
        nodes = complete_nodes(graph.declared, ends, graph.default_type)
    if shares:
        nodes = nodes.withColumn("share", _share("node_id"))
    # By id, so that a look-up reads the buckets of its ids and a few row groups of them.
    node_table = f"tierwalk_nodes_{uuid.uuid4().hex}"
    dealt = nodes.repartition(buckets, "node_id").sortWithinPartitions("node_id")
    writer = dealt.write.bucketBy(buckets, "node_id")
    with shuffles_removed(spark), setting(spark, "spark.sql.maxConcurrentOutputFileWriters", WRITERS):
        writer.option("path", f"{root}/nodes").format("parquet").saveAsTable(node_table)
    # The layout is whole; what it was made from would be a second copy of the graph.
    ws.drop("arcs")
    if path:
        row = (buckets, key, n_pieces, bounded, odd_levels)
        spark.createDataFrame([row], LAYOUT_FACTS).coalesce(1).write.parquet(f"{root}/layout")
    return Graph(
        spark.table(node_table),
        spark.table(table),
        buckets=buckets,
        hubs=hubs if n_hubs else None,
        hubs_bounded=bounded,
        n_pieces=n_pieces,
        table=table,
        odd_levels=odd_levels,
        node_table=node_table,
    )


LAYOUT_FACTS = "buckets int, key string, n_pieces bigint, bounded boolean, odd_levels bigint"


def open_graph(spark: SparkSession, path: str) -> Graph:
    """A graph that ``lay_out`` wrote to ``path``, in any session; nothing is read or written for it."""
    facts = spark.read.schema(LAYOUT_FACTS).parquet(f"{path}/layout").first()

    def opened(part: str, key: str) -> str:
        table = f"tierwalk_{part}_{uuid.uuid4().hex}"
        schema = spark.read.parquet(f"{path}/{part}").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        order = f"share, {key}" if part == "edges" and "share" in schema.names else key
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({key})"
            f" SORTED BY ({order}) INTO {facts.buckets} BUCKETS LOCATION '{path}/{part}'"
        )
        return table

    table, node_table = opened("edges", facts.key), opened("nodes", "node_id")
    return Graph(
        spark.table(node_table),
        spark.table(table),
        buckets=facts.buckets,
        hubs=spark.read.parquet(f"{path}/hubs") if facts.n_pieces else None,
        hubs_bounded=facts.bounded,
        n_pieces=facts.n_pieces,
        table=table,
        odd_levels=facts.odd_levels,
        node_table=node_table,
    )


def close_graph(graph: Graph) -> None:
    """Forget the catalog entries of a laid out graph; its files stay."""
    for table in (graph.table, graph.node_table):
        if table:
            graph.spark.sql(f"DROP TABLE IF EXISTS {table}")


def build_property_graph(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give string ids dense long ids, from 1 in id order; attributes are kept.

    Returns vertices(node_id, id, ...) and edges(src, dst, ..., src_id, dst_id). The
    numbering is a range-partitioned sort with an offset per partition, so no task sees
    all ids.
    """
    ws = Workspace(vertices.sparkSession, "ids")
    ids = vertices.select("id").distinct()
    ranged = ids.repartitionByRange("id").withColumn("part", F.spark_partition_id())
    placed, _ = ws.save(ranged, "ranged")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row per partition of the sort.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    numbers = (
        placed.withColumn("place", local)
        .join(offsets, "part")
        .select("id", (F.col("offset") + F.col("place")).cast("bigint").alias("node_id"))
    )
    numbers, _ = ws.save(numbers, "numbers")
    as_src = numbers.select(F.col("id").alias("src"), F.col("node_id").alias("src_id"))
    as_dst = numbers.select(F.col("id").alias("dst"), F.col("node_id").alias("dst_id"))
    return (
        vertices.join(numbers, "id"),
        edges.join(as_src, "src").join(as_dst, "dst"),
    )


def triplets(graph: Graph) -> DataFrame:
    """Every edge with the types of both ends."""
    src = graph.nodes.select(
        F.col("node_id").alias("src"), F.col("type_id").alias("src_type"), F.col("name").alias("src_name")
    )
    dst = graph.nodes.select(F.col("node_id").alias("dst"), F.col("name").alias("dst_name"))
    return (
        graph.edges.select("src", "dst", "level", "dst_type")
        .join(src, "src")
        .join(dst, "dst")
        .select("src", "src_type", "src_name", "level", "dst", "dst_type", "dst_name")
    )


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def graph_stats(graph: Graph) -> DataFrame:
    """One row: node, implicit node and edge counts."""
    none = F.lit(0).cast("bigint")
    nodes = graph.nodes.agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.count_if("implicit").alias("n_implicit"),
        none.alias("n_edges"),
    )
    edges = graph.edges.agg(
        none.alias("n_nodes"), none.alias("n_implicit"), F.count(F.lit(1)).alias("n_edges")
    )
    return nodes.unionByName(edges).agg(
        *(F.sum(c).alias(c) for c in ("n_nodes", "n_implicit", "n_edges"))
    )


def type_counts(graph: Graph) -> DataFrame:
    """Number of nodes of each type."""
    return graph.nodes.groupBy("type_id").agg(F.count(F.lit(1)).alias("n_nodes"))


def type_table(spark: SparkSession, domain: Domain) -> DataFrame:
    """Type dictionary of a domain: a fixed table of a few rows."""
    rows = [(domain.domain_id, i, name) for i, name in enumerate(domain.type_names)]
    return spark.createDataFrame(rows, "domain int, type_id int, type_name string")


def with_type_names(nodes: DataFrame, domain: Domain) -> DataFrame:
    names = type_table(nodes.sparkSession, domain).select("type_id", "type_name")
    return nodes.join(F.broadcast(names), "type_id", "left")


def with_names(answers: DataFrame, graph: Graph, rows: int | None = None) -> DataFrame:
    """Add node names; answers without a named node drop out.

    ``rows`` bounds the number of answers, if the caller knows a bound. Few answers are
    written first and go to the nodes, of which only their buckets are read.
    """
    names = graph.nodes.filter(~F.col("implicit")).select("node_id", "name")
    if rows is not None and graph.node_table and rows <= graph.id_limit:
        answers, n = Workspace(graph.spark, "names").save(answers, "answers")
        names = only_ids(names, "node_id", few_ids(answers, "node_id", n, graph.id_limit))
    if rows is not None and rows <= BROADCAST_ROWS:
        answers = F.broadcast(answers)
    return answers.join(names, "node_id")


def lookup_nodes(graph: Graph, node_ids: list[int] | DataFrame) -> DataFrame:
    """Nodes by id: a few literal ids, or a table with a column node_id.

    Ids fewer than the buckets of a layout select their buckets, whichever way they come."""
    if not isinstance(node_ids, DataFrame):
        return graph.nodes.filter(F.col("node_id").isin(*node_ids))
    ids = few_ids(node_ids, "node_id", 0, graph.id_limit)
    return only_ids(graph.nodes, "node_id", ids).join(node_ids.select("node_id"), "node_id", "left_semi")


def remove_edges(graph: Graph, pairs: DataFrame) -> Graph:
    """Drop the directed (src, dst) pairs; nodes stay as they are.

    A layout keeps its buckets: walks meet the stored edges and leave out the pairs among those they touch.
    """
    pairs = pairs.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))
    kept = graph.edges.join(pairs, ["src", "dst"], "left_anti")
    if not graph.buckets:
        return replace(graph, edges=kept, declared=None, marked=None)
    removed = pairs if graph.removed is None else graph.removed.unionByName(pairs)
    stored = graph.edges if graph.stored is None else graph.stored
    return replace(graph, edges=kept, declared=None, stored=stored, removed=removed, marked=None)


def _share(node_id: str) -> Column:
    """The share of the graph, of 2**32, from which on a node belongs to it: a hash of its id, so both ends of an edge
    are decided without a join."""
    return F.conv(F.substring(F.md5(F.col(node_id).cast("string")), 1, 8), 16, 10).cast("bigint")


def graph_fraction(graph: Graph, ratio: float) -> Graph:
    """Induced subgraph on a fixed pseudo-random fraction of the nodes; on a nested layout it hashes nothing and reads no more than its part."""
    limit = F.lit(int(ratio * 2**32))
    if "share" in graph.edges.columns:
        part = graph.edges_where(lambda edges: edges.filter(F.col("share") < limit))
        return replace(part, declared=None, nodes=graph.nodes.filter(F.col("share") < limit))
    part = graph.edges_where(lambda edges: edges.filter((_share("src") < limit) & (_share("dst") < limit)))
    return replace(part, declared=None, nodes=graph.nodes.filter(_share("node_id") < limit))
