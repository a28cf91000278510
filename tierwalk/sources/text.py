"""Text inputs: edge lists, node files, adjacency files and query files.

Each ``read_*`` is a scan followed by ``parse_*(lines)``; ``lines`` has one string
column ``value``. Paths may be anything Spark's file systems understand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierwalk.functions import edge_level

# Fixed values of the file formats.
LABELS = ("same", "higher", "lower")
SECTION_LEVELS = {"higher": 1, "lower": -1, "same": 0}
NO_NEIGHBOUR = -10001
SEED_TYPES = (1, 4, 5, 6)
SEED_STRIDE = 10


def _fields(lines: DataFrame, sep: str) -> DataFrame:
    """Split the lines on a literal separator, leaving out blank ones.

    One plain character is split without a pattern; quoted, a pattern would be compiled for every line."""
    quoted = sep if len(sep) == 1 and sep not in ".$|()[{^?*+\\" else "\\Q" + sep + "\\E"
    return lines.filter(F.trim("value") != "").select(F.split("value", quoted).alias("f"))


def parse_edge_lines(lines: DataFrame, sep: str = "\t", strict: bool = False) -> DataFrame:
    """``src, dst, label`` lines to edges(src, dst, level)."""
    label = F.col("f")[2]
    if strict:
        label = F.when(label.isin(*LABELS), label).otherwise(
            F.raise_error(F.concat(F.lit("unknown edge label: "), label))
        )
    return _fields(lines, sep).select(
        F.col("f")[0].cast("bigint").alias("src"),
        F.col("f")[1].cast("bigint").alias("dst"),
        edge_level(label).alias("level"),
    )


def parse_node_lines(lines: DataFrame, sep: str = "\t") -> DataFrame:
    """``"name+++typeId", nodeId`` lines to nodes(node_id, type_id, name, raw_name)."""
    label = F.split(F.regexp_replace(F.col("f")[0], '"', ""), "\\+\\+\\+")
    return _fields(lines, sep).select(
        F.col("f")[1].cast("bigint").alias("node_id"),
        F.trim(label[1]).cast("int").alias("type_id"),
        label[0].alias("name"),
        F.col("f")[0].alias("raw_name"),
    )


def parse_node_table_lines(lines: DataFrame, sep: str = "\t") -> DataFrame:
    """``nodeId, name, typeId`` lines to nodes(node_id, type_id, name)."""
    return _fields(lines, sep).select(
        F.col("f")[0].cast("bigint").alias("node_id"),
        F.col("f")[2].cast("int").alias("type_id"),
        F.col("f")[1].alias("name"),
    )


def _sections(rows: DataFrame, text: str) -> tuple[DataFrame, dict[str, Column]]:
    """The rows, and by keyword the tokens of that adjacency section, up to the token that opens another section.

    Each step is a column of its own, so that it is worked out once, and nothing is searched for by a pattern."""
    keys = list(SECTION_LEVELS)

    def each(name: str, value) -> None:
        nonlocal rows
        rows = rows.withColumns({f"{name}_{k}": value(k, lambda part, k=k: F.col(f"{part}_{k}")) for k in keys})

    def others(key: str, rest: Column) -> list[Column]:
        return [F.nullif(F.locate(k, rest), F.lit(0)) for k in keys if k != key]

    # The first occurrence counts; the keyword is followed by a colon and a space.
    each("at", lambda key, part: F.locate(key, F.col(text)))
    each("rest", lambda key, part: F.when(part("at") > 0, F.substr(F.col(text), part("at") + len(key) + 2)))
    # The text is cut before it is split, so that each neighbour is looked at once.
    each("found", lambda key, part: F.least(*others(key, part("rest"))))
    each("before", lambda key, part: F.substr(part("rest"), F.lit(1), part("found") - 1))
    each("whole", lambda key, part: F.length(part("before")) - F.length(F.substring_index(part("before"), " ", -1)))

    def own(part) -> Column:
        rest, trimmed = part("rest"), F.rtrim(part("rest"))
        return (
            F.when(rest.isNull(), None)
            .when(rest == "", F.array(F.lit("")))
            .when(part("found").isNull(), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " ")))
            .when(part("whole") == 0, F.array().cast("array<string>"))
            .otherwise(F.split(F.substr(part("before"), F.lit(1), part("whole") - 1), " "))
        )

    return rows, {k: own(lambda part, k=k: F.col(f"{part}_{k}")) for k in keys}


def parse_adjacency(lines: DataFrame, sep: str = "\t", keep_sentinel: bool = False):
    """``id, typeId, higher: a b lower: c same: d`` lines to (nodes, edges).

    A section without neighbours gives no edge; with ``keep_sentinel`` it gives the
    edge to -10001 that marks an isolated node.
    """
    rows = _fields(lines, sep).select(
        F.col("f")[0].cast("bigint").alias("src"),
        F.col("f")[1].cast("int").alias("type_id"),
        F.get("f", F.lit(2)).alias("adjacency"),
    )
    nodes = rows.select(F.col("src").alias("node_id"), "type_id")
    cut, tokens = _sections(rows.select("src", "adjacency"), "adjacency")
    sections = F.array(
        *(F.struct(F.lit(level).alias("level"), tokens[key].alias("ids")) for key, level in SECTION_LEVELS.items())
    )
    listed = (
        cut.select("src", F.explode(sections).alias("s"))
        .select("src", F.col("s.level").alias("level"), F.explode("s.ids").alias("neighbour"))
    )
    if not keep_sentinel:
        listed = listed.filter(F.col("neighbour") != "")
    neighbour = F.nullif("neighbour", F.lit("")).cast("bigint")
    edges = listed.select(
        "src",
        F.coalesce(neighbour, F.lit(NO_NEIGHBOUR).cast("bigint")).alias("dst"),
        F.when(F.col("neighbour") == "", F.lit(0)).otherwise(F.col("level")).alias("level"),
    )
    return nodes, edges


def _star_rows(lines: DataFrame, query_id: str) -> DataFrame:
    return lines.filter(F.trim("value") != "").select(
        F.col(query_id).cast("bigint").alias("query_id"),
        F.posexplode(F.split("value", "\t")).alias("star_id", "star"),
    )


def _seed_rows(stars: DataFrame) -> DataFrame:
    part = F.split("seed", ",")
    return stars.select("query_id", "star_id", F.explode("seeds").alias("seed")).select(
        "query_id",
        "star_id",
        F.trim(part[0]).cast("bigint").alias("seed_id"),
        F.trim(part[1]).cast("int").alias("seed_type"),
    )


def parse_star_sets(lines: DataFrame, query_id: str = "query_id") -> DataFrame:
    """``id,type;id,type`` stars separated by tabs, one query per line, to query_seeds."""
    return _seed_rows(
        _star_rows(lines, query_id).select("query_id", "star_id", F.split("star", ";").alias("seeds"))
    )


def parse_query_lines(lines: DataFrame, query_id: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """As star sets, with the wanted type as last token, to (query_seeds, query_stars)."""
    tokens = F.split("star", ";")
    stars = _star_rows(lines, query_id).select(
        "query_id",
        "star_id",
        F.slice(tokens, F.lit(1), F.size(tokens) - 1).alias("seeds"),
        F.trim(F.element_at(tokens, -1)).cast("int").alias("dst_type"),
    )
    return _seed_rows(stars), stars.select("query_id", "star_id", "dst_type")


def pick_seeds(nodes: DataFrame, n: int, types=SEED_TYPES, stride: int = SEED_STRIDE) -> DataFrame:
    """Every ``stride``-th node of the given types in id order, ``n`` of them.

    Only the first ``n * stride + 1`` rows matter, so the numbering sees no more.
    """
    head = nodes.filter(F.col("type_id").isin(*types)).orderBy("node_id").limit(n * stride + 1)
    place = F.row_number().over(Window.orderBy("node_id")) - 1
    return (
        head.select("node_id", "type_id", place.alias("place"))
        .filter((F.col("place") > 0) & (F.col("place") % stride == 0))
        .select(F.col("node_id").alias("seed_id"), F.col("type_id").alias("seed_type"))
    )


def _line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """Lines of query files with their positions among the lines that are not blank, from 0, files by path.

    A scan packs splits of files by size, so its partitions say nothing about the order of files: file, start of the split
    and place within it order the lines; one row per split is added up to tell where each begins.
    """
    split = ["file", "start"]
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
    )
    lines = lines.filter(F.trim("value") != "")
    sizes = lines.groupBy(*split).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*split, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy(*split).orderBy("place")) - 1
    return (
        lines.withColumn("local", local)
        .join(offsets, split)
        .select("value", (F.col("offset") + F.col("local")).cast("bigint").alias("query_id"))
    )


def read_edge_list(spark: SparkSession, path: str, sep: str = "\t", strict: bool = False) -> DataFrame:
    return parse_edge_lines(spark.read.text(path), sep, strict)


def read_node_info(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return parse_node_lines(spark.read.text(path), sep)


def read_node_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return parse_node_table_lines(spark.read.text(path), sep)


def read_adjacency(spark: SparkSession, path: str, sep: str = "\t", keep_sentinel: bool = False):
    return parse_adjacency(spark.read.text(path), sep, keep_sentinel)


def read_star_sets(spark: SparkSession, path: str) -> DataFrame:
    return parse_star_sets(_line_numbers(spark, path))


def read_queries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_query_lines(_line_numbers(spark, path))
