"""What a change of a symbol reaches: categories, scores and reports, for many symbols at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import EFFECT, IMPACT
from .traverse import depths, reach

#: Parts of a path that tell a category.
ENTRY_PARTS, CORE_PARTS = "controller|route|api|cli|handler", "service|model|domain|repository"


def category(path: Column, name: Column, kind: Column, is_entrypoint: Column) -> Column:
    path, name = F.lower(F.coalesce(path, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(path.contains("test") | name.startswith("test_"), "TEST")
        .when(F.coalesce(is_entrypoint, F.lit(False)) | path.rlike(ENTRY_PARTS), "CRITICAL")
        .when(kind.isin("class", "interface") | path.rlike(CORE_PARTS), "HIGH")
        .otherwise("MEDIUM")
    )


#: The weights and bounds of the score.
def score(up: Column, down: Column, entrypoints: Column, files: Column, tests: Column) -> Column:
    """Weighted size of an impact, eased by tests, between 0 and 100, rounded half to even on one decimal."""
    raw = 4.0 * up + 1.5 * down + 20.0 * entrypoints + 5.0 * files
    eased = raw * F.when(tests > 0, F.greatest(F.lit(0.6), 1.0 - 0.08 * tests)).otherwise(1.25)
    return F.greatest(F.when((up > 0) | (down > 0), 1.0).otherwise(0.0), F.least(F.lit(100.0), F.bround(eased, 1)))


SEARCHES = {"up": (IMPACT, True), "down": (EFFECT, False)}


def _known(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    known = nodes.select(F.col("id").alias("node"), "name", "kind", "file_path", category(F.col("file_path"), F.col("name"), F.col("kind"), F.col("is_entrypoint")).alias("category"))
    return rows.join(known, "node").withColumnRenamed("node", "node_id")


def impact_nodes(nodes: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int = 10) -> DataFrame:
    """(root, direction, node_id, name, kind, file_path, depth, category) of all that each root reaches or is reached by."""
    return _known(depths(edges, roots, max_depth, SEARCHES), nodes)


def impact_paths(nodes: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int = 10) -> DataFrame:
    """impact_nodes() with path_from_target, from the node to the root, and way, the order in which a queue finds them."""
    both = [reach(edges, roots, max_depth, types, upstream).withColumn("direction", F.lit(name)) for name, (types, upstream) in SEARCHES.items()]
    return _known(both[0].unionByName(both[1]), nodes).withColumn("path_from_target", F.reverse("path")).drop("path")


def scores(reached: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """One row a root: up, down, files, entrypoints, tests, score and total_impacted, from impact_nodes(). Nothing is listed."""
    own = roots.select("root").distinct().join(nodes.select(F.col("id").alias("root"), F.col("name").alias("target_name"), F.col("file_path").alias("target_file")), "root")
    up, label = F.col("direction") == "up", F.concat("name", F.lit(" ("), "file_path", F.lit(")"))
    files = reached.select("root", "file_path").unionByName(own.select("root", F.col("target_file").alias("file_path"))).where("file_path is not null").distinct().groupBy("root").agg(F.count("*").alias("files"))
    sizes = reached.groupBy("root").agg(F.count_if(up).alias("up"), F.count_if(~up).alias("down"))
    named = reached.where(up & F.col("category").isin("CRITICAL", "TEST")).select("root", "category", label.alias("label")).distinct().groupBy("root").agg(F.count_if(F.col("category") == "CRITICAL").alias("entrypoints"), F.count_if(F.col("category") == "TEST").alias("tests"))
    rows = own.join(sizes, "root", "left").join(files, "root", "left").join(named, "root", "left").fillna(0, ["up", "down", "files", "entrypoints", "tests"])
    return rows.withColumn("score", score(F.col("up"), F.col("down"), F.col("entrypoints"), F.col("files"), F.col("tests"))).withColumn("total_impacted", F.col("up") + F.col("down"))


def reports(nodes: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int = 10) -> DataFrame:
    """One row a root: counts, score, affected files, entry points and tests, and the reached nodes in order."""
    reached = impact_paths(nodes, edges, roots, max_depth)
    up, down = F.col("direction") == "up", F.col("direction") == "down"
    label = F.concat("name", F.lit(" ("), "file_path", F.lit(")"))
    listed = F.struct("depth", "name", "way", "node_id", "category")
    per_root = reached.groupBy("root").agg(
        F.count_if(up).alias("up"), F.count_if(down).alias("down"), F.collect_set("file_path").alias("files"),
        F.array_sort(F.collect_set(F.when(up & (F.col("category") == "CRITICAL"), label))).alias("affected_entrypoints"),
        F.array_sort(F.collect_set(F.when(up & (F.col("category") == "TEST"), label))).alias("affected_tests"),
        F.transform(F.sort_array(F.collect_list(F.when(up, listed))), lambda x: x["node_id"]).alias("upstream_callers"),
        F.transform(F.sort_array(F.collect_list(F.when(down, listed))), lambda x: x["node_id"]).alias("downstream_callees"),
    )
    target = roots.select("root").distinct().join(nodes.select(F.col("id").alias("root"), F.col("name").alias("target_name"), F.col("file_path").alias("target_file")), "root")
    rows = target.join(per_root, "root", "left").fillna(0, ["up", "down"])
    none = F.array().cast("array<string>")
    rows = rows.withColumn("affected_files", F.array_sort(F.array_union(F.coalesce("files", none), F.array("target_file"))))
    for c in ("affected_entrypoints", "affected_tests", "upstream_callers", "downstream_callees"):
        rows = rows.withColumn(c, F.coalesce(c, none))
    sized = score(F.col("up"), F.col("down"), F.size("affected_entrypoints"), F.size("affected_files"), F.size("affected_tests"))
    return rows.withColumn("score", sized).withColumn("total_impacted", F.col("up") + F.col("down")).drop("files")
