"""The property graph as two DataFrames: vertices (id, attributes, node_seq) and edges (src, dst, attributes, edge_pos)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import blank_trim

#: The edge types, by the traversal that follows them.
IMPACT = ("CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS")
EFFECT = ("CALLS", "EXTENDS", "IMPLEMENTS")
COUPLING = ("CALLS", "IMPORTS")

ATTRIBUTES = ["name", "qualified_name", "kind", "file_path", "line_start", "line_end", "docstring", "is_exported", "is_entrypoint", "complexity"]


def vertices(symbols: DataFrame) -> DataFrame:
    """One row an id: the position of its first row, the attributes of its last; missing docstrings are empty."""
    attributes = F.max_by(F.struct(*ATTRIBUTES), "symbol_seq").alias("a")
    rows = symbols.where("id is not null").groupBy("id").agg(F.min("symbol_seq").alias("node_seq"), attributes)
    return rows.select("id", "node_seq", "a.*").withColumn("docstring", F.coalesce("docstring", F.lit("")))


def with_runtime(nodes: DataFrame, runtime_symbols: DataFrame) -> DataFrame:
    """nodes and those of the shared runtime library, which come first and have no lines."""
    extra = runtime_symbols.select("id", F.lit(-1).cast("bigint").alias("node_seq"), "name", "qualified_name", "kind", "file_path", *(F.lit(None).cast(t).alias(c) for c, t in (("line_start", "int"), ("line_end", "int"))), F.lit("").alias("docstring"), F.lit(True).alias("is_exported"), F.lit(False).alias("is_entrypoint"), F.lit(1).alias("complexity"))
    return nodes.unionByName(extra.join(nodes.select("id"), "id", "left_anti"))


def upsert_edges(edges: DataFrame) -> DataFrame:
    """One row a (src, dst): a later edge takes over type, line and file but not the position of the first."""
    typed = edges.where("source_id is not null and target_id is not null").withColumn("edge_type", F.upper(blank_trim(F.col("edge_type"))))
    last = F.max_by(F.struct("edge_type", "line_number", "file_path"), "edge_seq").alias("a")
    return typed.groupBy(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).agg(F.min("edge_seq").alias("edge_pos"), last).select("src", "dst", "edge_pos", "a.*")


def known_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges of which both ends are vertices."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def graph(symbols: DataFrame, runtime_symbols: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = with_runtime(vertices(symbols), runtime_symbols)
    return nodes, known_ends(upsert_edges(edges), nodes)
