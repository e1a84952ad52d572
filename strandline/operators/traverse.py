"""Breadth-first searches from many roots at once, and what builds on them.

A level is one join of the frontier with the edges, one aggregation that keeps a node's best way in, and one anti-join
with what was reached before. The order in which a queue would find nodes is the lexicographic order of the positions of
the edges on the way, carried as `way`, so no sort over a frontier is needed. Levels are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: A node with so large a share of the steps of a search, and so many, has them dealt to SALTS keys.
HOT_SHARE, HOT_LEAST, SALTS = 0.01, 10_000, 32


def depths(edges: DataFrame, roots: DataFrame, max_depth: int, searches: dict[str, tuple[tuple[str, ...] | None, bool]]) -> DataFrame:
    """(direction, root, node, depth) of every node within max_depth of each root, the root excluded.

    searches: by direction, the edge types to follow (None for all) and whether from callee to caller; all directions move
    one level in the same join. Only pairs are carried. The steps of a hub are dealt to several keys, so that no task
    holds all of them.
    """
    parts = []
    for name, (types, upstream) in searches.items():
        near, far = ("dst", "src") if upstream else ("src", "dst")
        used = edges if types is None else edges.where(F.col("edge_type").isin(*types))
        parts.append(used.select(F.lit(name).alias("direction"), F.col(near).alias("node"), F.col(far).alias("far")))
    steps = cut(_union(parts).distinct())
    total = steps.count()
    hubs = steps.groupBy("direction", "node").count().where(F.col("count") >= F.lit(max(HOT_LEAST, HOT_SHARE * total))).select("direction", "node")  # at most 1 / HOT_SHARE rows
    hubs = F.broadcast(cut(hubs).withColumn("hub", F.lit(True)))
    dealt = steps.join(hubs, ["direction", "node"], "left").select("direction", "node", "far", F.when(F.col("hub"), F.pmod(F.xxhash64("far"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"))
    start = roots.select("root").distinct().select(F.explode(F.array(*map(F.lit, searches))).alias("direction"), "root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    levels = [cut(start)]
    for depth in range(1, max_depth + 1):
        salts = F.explode(F.when(F.col("hub"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
        frontier = levels[-1].join(hubs, ["direction", "node"], "left").select("direction", "root", "node", salts.alias("salt"))
        tried = frontier.join(dealt, ["direction", "node", "salt"]).select("direction", "root", F.col("far").alias("node")).distinct()
        seen = _union([x.select("direction", "root", "node") for x in levels])
        level = cut(tried.join(seen, ["direction", "root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        levels.append(level)
    return _union(levels).where("depth > 0")


def reach(edges: DataFrame, roots: DataFrame, max_depth: int, types: tuple[str, ...] | None, upstream: bool, stop: DataFrame | None = None) -> DataFrame:
    """(root, node, depth, path, way) of every node within max_depth of each root, the root excluded.

    path runs from the root to the node. roots: one column root. stop: (root, node) pairs; the search ends with the level
    on which all have been found.
    """
    near, far = ("dst", "src") if upstream else ("src", "dst")
    used = edges if types is None else edges.where(F.col("edge_type").isin(*types))
    steps = cut(used.select(F.col(near).alias("near"), F.col(far).alias("far"), "edge_pos"))
    start = roots.select("root").distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.array("root").alias("path"), F.array().cast("array<bigint>").alias("way"))
    levels = [cut(start)]
    for depth in range(1, max_depth + 1):
        tried = levels[-1].join(steps, F.col("node") == F.col("near")).select("root", F.col("far").alias("node"), F.struct(F.concat("way", F.array("edge_pos")).alias("way"), "path").alias("best"))
        seen = _union([x.select("root", "node") for x in levels])
        best = tried.groupBy("root", "node").agg(F.min("best").alias("best")).join(seen, ["root", "node"], "left_anti")
        level = cut(best.select("root", "node", F.lit(depth).alias("depth"), F.concat("best.path", F.array("node")).alias("path"), "best.way"))
        if level.isEmpty():
            break
        levels.append(level)
        if stop is not None and stop.join(_union(levels).select("root", "node"), ["root", "node"], "left_anti").isEmpty():
            break
    return _union(levels).where("depth > 0")


def shortest_paths(edges: DataFrame, pairs: DataFrame, types: tuple[str, ...], max_depth: int = 64) -> DataFrame:
    """(source, target, total_hops, path) of each reachable pair; a node to itself has 0 hops."""
    pairs = pairs.select("source", "target").distinct()
    other = pairs.where("source <> target").select(F.col("source").alias("root"), F.col("target").alias("node"))
    found = reach(edges, other.select("root"), max_depth, types, upstream=False, stop=other).join(other, ["root", "node"]).select(F.col("root").alias("source"), F.col("node").alias("target"), F.col("depth").alias("total_hops"), "path")
    same = pairs.where("source = target").select("source", "target", F.lit(0).alias("total_hops"), F.array("source").alias("path"))
    return found.unionByName(same)


def hops(paths: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row a hop of each path, with names, files, type and line."""
    at = paths.select("source", "target", F.posexplode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("a"), F.slice("path", F.lit(2), F.size("path") - 1).alias("b"))).alias("hop", "ab"))
    at = at.select("source", "target", (F.col("hop") + 1).alias("hop"), F.col("ab.a").alias("src"), F.col("ab.b").alias("dst"))
    names = nodes.select("id", "name", "file_path")
    at = at.join(edges.select("src", "dst", "edge_type", "line_number"), ["src", "dst"])
    at = at.join(names.select(F.col("id").alias("src"), F.col("name").alias("from_name"), F.col("file_path").alias("from_file")), "src")
    return at.join(names.select(F.col("id").alias("dst"), F.col("name").alias("to_name"), F.col("file_path").alias("to_file")), "dst")


def simple_paths(edges: DataFrame, pairs: DataFrame, types: tuple[str, ...], cutoff: int = 8, max_paths: int = 5) -> DataFrame:
    """(source, target, hops, path): the first max_paths simple paths of at most cutoff edges, shortest first, then by path.

    Only nodes from which the target is near enough are entered, by a search backwards from it. A length is enumerated
    only while fewer than max_paths shorter ones are known.
    """
    used = edges.where(F.col("edge_type").isin(*types)).select("src", "dst")
    pairs = pairs.select("source", "target").distinct()
    targets = pairs.select(F.col("target").alias("root"))
    back = reach(edges, targets, cutoff, types, upstream=True).select(F.col("root").alias("target"), F.col("node"), "depth").unionByName(targets.distinct().select(F.col("root").alias("target"), F.col("root").alias("node"), F.lit(0).alias("depth")))
    back = cut(back)
    partial = cut(pairs.select("source", "target", F.col("source").alias("node"), F.array("source").alias("path")))
    done: list[DataFrame] = []
    for n in range(1, cutoff + 1):
        grown = partial.join(used, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select("source", "target", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        grown = cut(grown.join(back.where(F.col("depth") <= cutoff - n).select("target", "node"), ["target", "node"], "left_semi"))
        if grown.isEmpty():
            break
        done.append(grown.where("node = target").select("source", "target", F.lit(n).alias("hops"), "path"))
        enough = _union(done).groupBy("source", "target").count().where(F.col("count") >= max_paths).select("source", "target")
        partial = grown.where("node <> target").join(enough, ["source", "target"], "left_anti")
    if not done:
        return pairs.where("false").select("source", "target", F.lit(0).alias("hops"), F.array("source").alias("path"))
    first = _union(done).groupBy("source", "target").agg(F.slice(F.sort_array(F.collect_list(F.struct("hops", "path"))), 1, max_paths).alias("p"))
    return first.select("source", "target", F.explode("p").alias("p")).select("source", "target", "p.hops", "p.path")


def ego(edges: DataFrame, roots: DataFrame, upstream_depth: int = 2, downstream_depth: int = 2) -> DataFrame:
    """(root, src, dst, edge_type): the graph induced by what is near a root, on all edge types.

    The search downwards does not enter nodes that the one upwards has found.
    """
    up = depths(edges, roots, upstream_depth, {"up": (None, True)}).select("root", "node")
    included = up.unionByName(roots.select("root", F.col("root").alias("node")).distinct())
    frontier, held = roots.select("root", F.col("root").alias("node")).distinct(), included
    for _ in range(downstream_depth):
        nearby = frontier.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("root", F.col("dst").alias("node")).distinct()
        frontier = cut(nearby.join(held, ["root", "node"], "left_anti"))
        held = held.unionByName(frontier)
    held = cut(held.distinct())
    inside = edges.join(held.select("root", F.col("node").alias("src")), "src")
    return inside.join(held.select("root", F.col("node").alias("dst")), ["root", "dst"], "left_semi").select("root", "src", "dst", "edge_type")
