"""Files and symbols that depend on each other in circles."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .graph import COUPLING


def file_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) files with a call or import from one to the other."""
    path = nodes.where("file_path is not null and file_path <> ''").select("id", "file_path")
    used = edges.where(F.col("edge_type").isin(*COUPLING)).select("src", "dst")
    src, dst = (path.select(F.col("id").alias(c), F.col("file_path").alias(f"{c}_file")) for c in ("src", "dst"))
    both = used.join(src, "src").join(dst, "dst").where("src_file <> dst_file")
    return both.select(F.col("src_file").alias("src"), F.col("dst_file").alias("dst")).distinct()


def symbol_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls between two different symbols that are no modules."""
    ids = nodes.where("kind <> 'module'").select("id")
    used = edges.where("edge_type = 'CALLS' and src <> dst").select("src", "dst").distinct()
    return used.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def _trimmed(pairs: DataFrame) -> DataFrame:
    """pairs without ends that nothing enters or nothing leaves, again and again."""
    pairs = cut(pairs)
    n = pairs.count()
    while n:
        inner = pairs.join(pairs.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(pairs.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        pairs = cut(inner.select("src", "dst"))
        now = pairs.count()
        if now == n:
            break
        n = now
    return pairs


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) of strongly connected components of more than one node; component is their least node.

    Trim; colour every node with the least node that reaches it; the nodes of a colour that reach its namesake are one
    component. Repeat on the rest.
    """
    spark = pairs.sparkSession
    left = _trimmed(pairs.where("src <> dst").select("src", "dst").distinct())
    found: list[DataFrame] = []
    while not left.isEmpty():
        colour = cut(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("colour", F.col("node")))
        while True:
            pushed = left.join(colour, left.src == colour.node).select(F.col("dst").alias("node"), "colour")
            new = cut(colour.union(pushed).groupBy("node").agg(F.min("colour").alias("colour")))
            same = new.join(colour, ["node", "colour"], "left_anti").isEmpty()
            colour = new
            if same:
                break
        tinted = cut(left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c")), ["dst", "c"]).select("src", "dst", "c"))
        members = cut(colour.where("node = colour").select("node", F.col("colour").alias("c")))
        frontier = members
        while True:
            back = tinted.join(frontier.select(F.col("node").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("node"), "c").distinct()
            frontier = cut(back.join(members, ["node", "c"], "left_anti"))
            if frontier.isEmpty():
                break
            members = cut(members.unionByName(frontier))
        big = members.groupBy("c").count().where("count > 1").select("c")
        found.append(cut(members.join(big, "c", "left_semi").select("node", F.col("c").alias("component"))))
        gone = members.select("node")
        left = _trimmed(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    out = spark.createDataFrame([], "node string, component string")
    for f in found:
        out = out.unionByName(f)
    return out


def cycles(pairs: DataFrame, max_cycles: int = 100, max_length: int | None = None) -> DataFrame:
    """(length, nodes): simple cycles from their least node on, closed, the first max_cycles by (length, nodes).

    Longer ones are looked for only while shorter ones are fewer than max_cycles, and only within components. Without
    max_length the search ends with the longest path of a component.
    """
    inside = components(pairs)
    inside = cut(inside)
    a, b = (inside.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c")) for c in ("src", "dst"))
    used = cut(pairs.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("src_c = dst_c and src <> dst").select("src", "dst"))
    paths = used.where("dst > src").select(F.col("src").alias("start"), F.col("dst").alias("node"), F.array("src", "dst").alias("nodes"))
    done: DataFrame | None = None
    for length in count(2) if max_length is None else range(2, max_length + 1):
        paths = cut(paths)
        if paths.isEmpty():
            break
        closed = paths.join(used.select(F.col("src").alias("node"), F.col("dst").alias("start")), ["node", "start"], "left_semi").select(F.lit(length).alias("length"), F.concat("nodes", F.array("start")).alias("nodes"))
        done = closed if done is None else done.unionByName(closed)
        if done.count() >= max_cycles:
            break
        paths = paths.join(used, F.col("node") == F.col("src")).where((F.col("dst") > F.col("start")) & ~F.array_contains("nodes", F.col("dst"))).select("start", F.col("dst").alias("node"), F.concat("nodes", F.array("dst")).alias("nodes"))
    if done is None:
        return pairs.sparkSession.createDataFrame([], "length int, nodes array<string>")
    return done.orderBy("length", "nodes").limit(max_cycles)
