"""Parent-child links to full hierarchies, by pointer doubling.

Every node keeps a pointer to an ancestor and the distance to it. In each round the pointer's own pointer is looked up
(one equi-join), so the distance doubles: a tree of depth d is resolved in about log2(d) rounds. Rows that have
reached a root leave the rounds. A round that resolves nothing proves that all rows left hang on cycles; doubling
then goes on over these rows alone until the set of pointed-at nodes stops shrinking: that set is the cycles' nodes.

The side that is looked up has one row a node, so a parent of very many children makes one side of a join skewed only,
which adaptive execution splits; once few rows are left in the rounds, they are broadcast and nothing else moves.

Defined results: null ends are ignored; repeated links count once; a link from a node to itself is a cycle; of several
parents of a node its self-link counts, else the smallest id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import blank_trim, cut, drop_cut

KINDS = ("CONTAINS", "EXTENDS")


def parent_links(edges: DataFrame) -> DataFrame:
    """(edge_type, node_id, parent_id), one row a node: CONTAINS points down, EXTENDS points up."""
    kind = F.upper(blank_trim(F.col("edge_type")))
    down = F.col("edge_type") == "CONTAINS"
    links = (
        edges.select(kind.alias("edge_type"), "source_id", "target_id")
        .where(F.col("edge_type").isin(*KINDS) & F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
        .select("edge_type", F.when(down, F.col("target_id")).otherwise(F.col("source_id")).alias("node_id"), F.when(down, F.col("source_id")).otherwise(F.col("target_id")).alias("parent_id"))
    )
    first = F.min(F.struct((F.col("parent_id") != F.col("node_id")).alias("other"), F.col("parent_id").alias("id")))
    return links.groupBy("edge_type", "node_id").agg(first.alias("p")).select("edge_type", "node_id", F.col("p.id").alias("parent_id"))


def resolve(links: DataFrame, with_path: bool = False) -> DataFrame:
    """(edge_type, node_id, root_id, depth[, path]) of each node that has a parent.

    depth is -1 and root_id '' on a cycle, -2 and '' below one. path runs from the root to the node; null with a cycle.
    """
    path = [F.array("parent_id").alias("path")] if with_path else []
    names = ["edge_type", "node_id", "anc", "dist", *(["path"] if with_path else [])]
    first = links.select("edge_type", "node_id", F.col("parent_id").alias("anc"), F.lit(1).alias("dist"), *path)
    first = cut(first)
    nodes = first.select("edge_type", F.col("node_id").alias("anc"), F.lit(True).alias("_inner"))
    state = cut(first.join(nodes, ["edge_type", "anc"], "left").select(*names, F.coalesce("_inner", F.lit(False)).alias("open")))
    drop_cut(first)
    done, active = [state.where("not open").select(*names)], state.where("open")
    left = active.count()
    held = [state]
    while left:
        known = _all(done).withColumn("open", F.lit(False)).unionByName(active)
        step = known.select("edge_type", F.col("node_id").alias("anc"), F.col("anc").alias("_anc"), F.col("dist").alias("_dist"), F.col("open").alias("_open"), *([F.col("path").alias("_path")] if with_path else []))
        more = [F.concat("path", "_path").alias("path")] if with_path else []
        moved = active.drop("open").join(step, ["edge_type", "anc"]).select("edge_type", "node_id", F.col("_anc").alias("anc"), (F.col("dist") + F.col("_dist")).alias("dist"), *more, F.col("_open").alias("open"))
        moved = cut(moved)
        held.append(moved)
        done.append(moved.where("not open").select(*names))
        active, before = moved.where("open"), left
        left = active.count()
        if left == before:
            break
    out = [_all(done).select("edge_type", "node_id", F.col("anc").alias("root_id"), F.col("dist").alias("depth"), *([F.concat(F.reverse("path"), F.array("node_id")).alias("path")] if with_path else []))]
    if left:
        out.append(_cyclic(active.select("edge_type", "node_id", "anc"), with_path))
    return _all(out)


def _all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def _cyclic(rows: DataFrame, with_path: bool) -> DataFrame:
    """Cycle nodes are those still pointed at once the set of targets is stable under doubling."""
    rows = cut(rows)
    targets = rows.select("edge_type", "anc").distinct().count()
    while True:
        step = rows.select("edge_type", F.col("node_id").alias("anc"), F.col("anc").alias("_anc"))
        rows, before = cut(rows.join(step, ["edge_type", "anc"]).select("edge_type", "node_id", F.col("_anc").alias("anc"))), rows
        drop_cut(before)
        now = rows.select("edge_type", "anc").distinct().count()
        if now == targets:
            break
        targets = now
    on = rows.select("edge_type", F.col("anc").alias("node_id"), F.lit(True).alias("_on")).distinct()
    path = [F.lit(None).cast("array<string>").alias("path")] if with_path else []
    return rows.select("edge_type", "node_id").join(on, ["edge_type", "node_id"], "left").select("edge_type", "node_id", F.lit("").alias("root_id"), F.when(F.col("_on"), -1).otherwise(-2).alias("depth"), *path)


def descendants(resolved: DataFrame) -> DataFrame:
    """(edge_type, ancestor_id, node_id, distance): every node under each ancestor, from paths; cycles give none."""
    return (
        resolved.where("path is not null")
        .select("edge_type", "node_id", "depth", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("pos", "ancestor_id"))
        .select("edge_type", "ancestor_id", "node_id", (F.col("depth") - F.col("pos")).cast("int").alias("distance"))
    )
