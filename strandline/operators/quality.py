"""Unreferenced code, metrics, coupling and rules of architecture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import matches
from .graph import COUPLING, IMPACT

#: Names that frameworks call.
ENTRY_NAMES = ("main", "handler", "app", "cli", "setUp", "tearDown", "init")


def dead_code(nodes: DataFrame, edges: DataFrame, include_exported: bool = False) -> DataFrame:
    """Symbols that nothing calls, imports, extends or implements, tests and entry points aside."""
    name, path = F.col("name"), F.col("file_path")
    spared = F.lower(path).contains("test") | name.startswith("test_") | name.endswith("Test") | (name.startswith("__") & name.endswith("__")) | name.isin(*ENTRY_NAMES) | F.col("is_entrypoint")
    if not include_exported:
        spared = spared | (F.col("is_exported") & (path.endswith("__init__.py") | path.endswith("index.ts")))
    candidates = nodes.where(~F.col("kind").isin("module", "variable") & ~F.coalesce(spared, F.lit(False)))
    used = edges.where(F.col("edge_type").isin(*IMPACT)).select(F.col("dst").alias("id")).distinct()  # a hub would else sit in one task
    return candidates.join(used, "id", "left_anti").select("id", "name", "qualified_name", "kind", "file_path", "line_start", "line_end", "complexity")


def module_of(path: Column) -> Column:
    """The folder of a file; of a file without one, its name without extension."""
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    return F.when(folder != "", folder).otherwise(F.regexp_replace(path, r"(?<=.)\.[^.]*$", ""))


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    own = F.col("kind") != "module"
    a = nodes.agg(F.countDistinct("file_path").alias("total_files"), F.count_if(own).alias("total_symbols"), F.bround(F.sum(F.when(own, F.col("complexity")).otherwise(0)) / F.greatest(F.lit(1), F.count_if(own)), 2).alias("avg_complexity"))
    return a.withColumn("total_edges", edges.agg(F.count("*").alias("n")).scalar())


def metrics(nodes: DataFrame, edges: DataFrame, cycles: DataFrame, dead: DataFrame) -> DataFrame:
    """totals() with the number of cycles and of unreferenced symbols."""
    count = lambda df: df.agg(F.count("*").alias("n")).scalar()
    return totals(nodes, edges).withColumns({"cycles_count": count(cycles), "dead_symbols_count": count(dead)})


def languages(nodes: DataFrame) -> DataFrame:
    """Vertices by extension of their file."""
    return nodes.groupBy(F.regexp_extract("file_path", r"(?<=[^/])(\.[^./]*)$", 1).alias("extension")).agg(F.count("*").alias("n"))


def coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(module_name, ca, ce, instability) of each module: edges from and to other modules, each edge counted."""
    at = nodes.where("file_path is not null and file_path <> ''").select("id", module_of(F.col("file_path")).alias("m"))
    src, dst = (at.select(F.col("id").alias(c), F.col("m").alias(f"{c}_m")) for c in ("src", "dst"))
    across = edges.where(F.col("edge_type").isin(*COUPLING)).select("src", "dst").join(src, "src").join(dst, "dst").where("src_m <> dst_m")
    ends = F.explode(F.array(F.struct(F.col("dst_m").alias("m"), F.lit(1).alias("ca"), F.lit(0).alias("ce")), F.struct(F.col("src_m").alias("m"), F.lit(0).alias("ca"), F.lit(1).alias("ce"))))
    counted = across.select(ends.alias("x")).select("x.*").unionByName(at.select("m").distinct().select("m", F.lit(0).alias("ca"), F.lit(0).alias("ce"))).groupBy(F.col("m").alias("module_name")).agg(F.sum("ca").alias("ca"), F.sum("ce").alias("ce"))
    return counted.withColumn("instability", F.when(F.col("ca") + F.col("ce") > 0, F.bround(F.col("ce") / (F.col("ca") + F.col("ce")), 2)).otherwise(0.0))


def bottlenecks(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """The functions, methods and classes that most edges call or import, ties in the order of the vertices."""
    n = edges.where(F.col("edge_type").isin(*COUPLING)).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    known = nodes.where(F.col("kind").isin("function", "method", "class")).select("id", "name", "node_seq")
    return known.join(n, "id").orderBy(F.desc("in_degree"), "node_seq", "id").limit(top).select("id", "name", "in_degree")


# --- rules


def forbidden(nodes: DataFrame, edges: DataFrame, rules: list[dict]) -> DataFrame:
    """One row an edge and broken rule. rules: from, to (path patterns), message, severity."""
    path = nodes.select("id", "file_path")
    src, dst = (path.select(F.col("id").alias(c), F.col("file_path").alias(f"{c}_file")) for c in ("src", "dst"))
    used = edges.where(F.col("edge_type").isin("IMPORTS", "CALLS")).select("src", "dst", "line_number", "edge_pos").join(src, "src").join(dst, "dst")
    broken = [
        F.when(matches(F.col("src_file"), r["from"]) & matches(F.col("dst_file"), r["to"]), F.struct(F.lit(i).alias("rule"), F.lit(r.get("severity", "error")).alias("severity"), F.coalesce(F.lit(r.get("message")), F.concat(F.lit("Forbidden dependency from "), "src_file", F.lit(" to "), "dst_file")).alias("message")))
        for i, r in enumerate(rules)
    ]
    if not broken:
        return used.where("false").select(F.lit("forbidden").alias("rule_type"), "src", "dst", F.lit("").alias("source_location"), F.col("dst_file").alias("target_location"), F.lit("").alias("message"), F.lit("").alias("severity"))
    hit = used.withColumn("r", F.explode(F.array_compact(F.array(*broken))))
    line = F.when(F.coalesce("line_number", F.lit(0)) == 0, 1).otherwise(F.col("line_number"))
    return hit.select(F.lit("forbidden").alias("rule_type"), "src", "dst", F.concat("src_file", F.lit(":"), line.cast("string")).alias("source_location"), F.col("dst_file").alias("target_location"), "r.message", "r.severity")


def unstable(coupled: DataFrame, rules: list[dict]) -> DataFrame:
    """Modules whose instability is over the bound of a rule (module pattern, max_i)."""
    broken = [F.when(matches(F.col("module_name"), r["module"]) & (F.col("instability") > r.get("max_i", 0.5)), F.lit(float(r.get("max_i", 0.5)))) for r in rules]
    if not broken:
        return coupled.where("false").withColumn("max_i", F.lit(0.5))
    return coupled.withColumn("max_i", F.explode(F.array_compact(F.array(*broken)))).select("module_name", "instability", "max_i")


def too_complex(nodes: DataFrame, max_complexity: int = 20) -> DataFrame:
    if max_complexity <= 0:
        return nodes.where("false").select("id", "file_path", "line_start", "complexity")
    return nodes.where(F.col("kind").isin("function", "method") & (F.col("complexity") > max_complexity)).select("id", "file_path", "line_start", "complexity")


def violations(nodes: DataFrame, edges: DataFrame, forbidden_rules: list[dict], stability: list[dict], max_complexity: int = 20) -> DataFrame:
    """(rule_type, source_location, target_location, message, severity): what breaks any of the rules."""
    none = F.lit(None).cast("string")
    a = forbidden(nodes, edges, forbidden_rules).select("rule_type", "source_location", "target_location", "message", "severity")
    b = unstable(coupling(nodes, edges), stability).select(F.lit("instability").alias("rule_type"), F.col("module_name").alias("source_location"), none.alias("target_location"), F.format_string("Module %s has instability %.2f over %.2f", "module_name", "instability", "max_i").alias("message"), F.lit("error").alias("severity"))
    c = too_complex(nodes, max_complexity).select(F.lit("complexity").alias("rule_type"), F.concat("file_path", F.lit(":"), F.coalesce("line_start", F.lit(1)).cast("string")).alias("source_location"), none.alias("target_location"), F.format_string("%s has complexity %d over %d", "id", "complexity", F.lit(max_complexity)).alias("message"), F.lit("warning").alias("severity"))
    return a.unionByName(b).unionByName(c)


def lint_counts(violations: DataFrame) -> DataFrame:
    return violations.agg(F.count("*").alias("total"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
