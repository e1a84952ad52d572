"""Queries of the code-graph operators over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, cycles, graph, impact, link, quality, search, traverse
from ..session import cut, table

#: Searches start from every symbol whose number is divisible by this.
EVERY = 20
RULES = [{"from": "src/*/handlers/*", "to": "src/*/models/*", "severity": "error"}, {"from": "src/shared/*", "to": "src/billing/**", "message": "shared code must not know billing", "severity": "warning"}]
STABILITY = [{"module": "src/shared/*", "max_i": 0.5}, {"module": "internal/*", "max_i": 0.6}]


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return graph.graph(table(spark, d, "symbols"), table(spark, d, "runtime_symbols"), table(spark, d, "edges"))


def _kept(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = _graph(spark, d)
    return cut(nodes), cut(edges)


def _roots(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("node_seq") >= 0) & (F.col("kind") != "module") & (F.col("node_seq") % EVERY == 0)).select(F.col("id").alias("root"))


def _depths(spark, d, direction):
    nodes, edges = _kept(spark, d)
    return traverse.depths(edges, _roots(nodes), 10, {direction: impact.SEARCHES[direction]}).select("root", F.col("node").alias("node_id"), "depth")


def blast_upstream(spark, d):
    return _depths(spark, d, "up")


def blast_downstream(spark, d):
    return _depths(spark, d, "down")


def blast_category(spark, d):
    nodes, edges = _kept(spark, d)
    return impact.impact_nodes(nodes, edges, _roots(nodes)).select("root", "direction", "node_id", "depth", "category")


def blast_score(spark, d):
    nodes, edges = _kept(spark, d)
    roots = cut(_roots(nodes))
    return impact.scores(cut(impact.impact_nodes(nodes, edges, roots)), nodes, roots).select("root", "up", "down", "entrypoints", "files", "tests", "score", "total_impacted")


def blast_report(spark, d):
    nodes, edges = _kept(spark, d)
    rows = impact.reports(nodes, edges, _roots(nodes))
    text = lambda c: F.array_join(c, " ; ").alias(c)
    return rows.select("root", "target_name", "target_file", "score", "up", "down", *map(text, ("affected_files", "affected_entrypoints", "affected_tests", "upstream_callers", "downstream_callees")), "total_impacted")


def blast_paths(spark, d):
    """Of each reached node the way that a search in the order of the edges finds first."""
    nodes, edges = _kept(spark, d)
    return impact.impact_paths(nodes, edges, _roots(nodes)).select("root", "direction", "node_id", "depth", F.array_join("path_from_target", " > ").alias("path"))


def _pairs(nodes, edges):
    """Each root and the farthest symbol that it uses, directly or not, of several the last by id; those that use none, with themselves."""
    roots = cut(_roots(nodes))
    far = traverse.depths(edges, roots, 10, {"down": (graph.IMPACT, False)}).groupBy("root").agg(F.max_by("node", F.struct("depth", "node")).alias("node"))
    return cut(roots.join(far, "root", "left").select(F.col("root").alias("source"), F.coalesce("node", "root").alias("target")))


def shortest_path_hops(spark, d):
    nodes, edges = _kept(spark, d)
    return traverse.shortest_paths(edges, _pairs(nodes, edges), graph.IMPACT).select("source", "target", "total_hops")


def path_result(spark, d):
    nodes, edges = _kept(spark, d)
    return traverse.hops(traverse.shortest_paths(edges, _pairs(nodes, edges), graph.IMPACT), edges, nodes)


def simple_paths(spark, d):
    nodes, edges = _kept(spark, d)
    return traverse.simple_paths(edges, _pairs(nodes, edges), graph.COUPLING).select("source", "target", "hops", F.array_join("path", " > ").alias("path"))


def ego_subgraph(spark, d):
    nodes, edges = _kept(spark, d)
    return traverse.ego(edges, cut(_roots(nodes)))


def symbol_search(spark, d):
    return search.find_symbols(_graph(spark, d)[0], "Ledger")


def resolve_target(spark, d):
    nodes, _ = _graph(spark, d)
    names = table(spark, d, "calls").where("callee_name is not null").select(F.col("callee_name").alias("query")).distinct()
    return search.resolve(nodes, names)


def filter_list(spark, d):
    return search.filter_list(_graph(spark, d)[0], "voucher")


def source_preview(spark, d):
    return search.source_preview(graph.vertices(table(spark, d, "symbols")), table(spark, d, "parsed_files").groupBy("file_path").agg(F.min("content").alias("content"))).select("id", "line_start", "line_end", F.md5("source").alias("source_md5"))


def dead_code(spark, d):
    return quality.dead_code(*_graph(spark, d))


def repo_totals(spark, d):
    return quality.totals(*_graph(spark, d))


def language_histogram(spark, d):
    return quality.languages(_graph(spark, d)[0])


def coupling(spark, d):
    return quality.coupling(*_graph(spark, d))


def bottlenecks(spark, d):
    return quality.bottlenecks(*_graph(spark, d))


def lint_forbidden(spark, d):
    nodes, edges = _graph(spark, d)
    return quality.forbidden(nodes, edges, RULES)


def lint_instability(spark, d):
    return quality.unstable(quality.coupling(*_graph(spark, d)), STABILITY)


def lint_complexity(spark, d):
    return quality.too_complex(_graph(spark, d)[0], 20)


def lint_violations(spark, d):
    return quality.violations(*_kept(spark, d), RULES, STABILITY)


def lint_counts(spark, d):
    return quality.lint_counts(lint_violations(spark, d))


def repo_metrics(spark, d):
    nodes, edges = _kept(spark, d)
    return quality.metrics(nodes, edges, module_cycles(spark, d), quality.dead_code(nodes, edges))


def file_graph(spark, d):
    return cycles.file_graph(*_graph(spark, d))


def file_components(spark, d):
    return cycles.components(cycles.file_graph(*_kept(spark, d)))


def module_cycles(spark, d):
    return cycles.cycles(cut(cycles.file_graph(*_kept(spark, d)))).select("length", F.array_join("nodes", " > ").alias("nodes"))


def symbol_cycles(spark, d):
    return cycles.cycles(cut(cycles.symbol_graph(*_kept(spark, d)))).select("length", F.array_join("nodes", " > ").alias("nodes"))


def edge_upsert(spark, d):
    return graph.upsert_edges(table(spark, d, "edges")).select("src", "dst", "edge_pos", "edge_type", "line_number")


def contains_edges(spark, d):
    return link.contains(link.symbol_rows(table(spark, d, "symbols")))


def import_resolution(spark, d):
    return link.resolve_imports(table(spark, d, "imports"), table(spark, d, "parsed_files")).select("import_id", "target_file")


def import_links(spark, d):
    return link.import_edges(table(spark, d, "imports"), table(spark, d, "parsed_files"), link.symbol_rows(table(spark, d, "symbols"))).select("repo_id", "src", "dst").distinct()


def call_links(spark, d):
    return link.call_edges(table(spark, d, "calls"), table(spark, d, "imports"), table(spark, d, "symbols")).select("call_id", "src", "dst", "rule")


def inheritance_link(spark, d):
    return link.inheritance_edges(table(spark, d, "inheritance"), table(spark, d, "symbols")).select("inherit_id", "src", "dst", "edge_type")


def linked_graph(spark, d):
    return link.build(*(table(spark, d, t) for t in ("parsed_files", "symbols", "imports", "calls", "inheritance"))).select("repo_id", "src", "dst", "edge_type")


def _diffs(spark, d):
    """A diff a file of a repository, made of the lines on which its calls stand."""
    lines = table(spark, d, "calls").where("line_number > 0 and file_path is not null").select("repo_id", "file_path", "line_number").distinct()
    hunk = F.concat(F.lit("@@ -"), F.col("line_number").cast("string"), F.lit(" +"), F.col("line_number").cast("string"), F.lit(",2 @@\n+x"))
    files = lines.groupBy("repo_id", "file_path").agg(F.array_join(F.sort_array(F.collect_list(hunk)), "\n").alias("h"))
    return files.select(F.concat(F.coalesce(F.col("repo_id").cast("string"), F.lit("")), F.lit(":"), "file_path").alias("diff_id"), F.concat(F.lit("diff --git a/"), "file_path", F.lit(" b/"), "file_path", F.lit("\n"), "h").alias("text"))


def diff_hunks(spark, d):
    return changes.parse_diff(_diffs(spark, d))


def diff_interval_join(spark, d):
    return changes.touched(changes.parse_diff(_diffs(spark, d)), graph.vertices(table(spark, d, "symbols")))


def diff_aggregate(spark, d):
    nodes, edges = _kept(spark, d)
    return changes.impact(cut(changes.parse_diff(_diffs(spark, d))), nodes, edges).select("diff_id", "symbols", "score", "total_impacted")


NAMES = (
    "blast_report blast_paths blast_upstream blast_downstream blast_category blast_score shortest_path_hops path_result simple_paths ego_subgraph symbol_search resolve_target filter_list source_preview dead_code repo_totals language_histogram coupling bottlenecks "
    "lint_forbidden lint_instability lint_complexity lint_violations lint_counts repo_metrics file_graph file_components module_cycles symbol_cycles edge_upsert contains_edges import_resolution import_links call_links inheritance_link linked_graph diff_hunks diff_interval_join diff_aggregate"
).split()
QUERIES = {n: globals()[n] for n in NAMES}
