"""The graph and its findings as JSON, DOT, Mermaid, SARIF, browser elements and HTML.

Lines are made where the rows are; only what is bounded by a parameter is put into one text.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, json): a JSON object a node and edge."""
    n = nodes.select(F.lit("node").alias("part"), F.to_json(F.struct("id", "name", "qualified_name", "kind", "file_path", "line_start", "line_end", "is_exported", "is_entrypoint", "complexity")).alias("json"))
    e = edges.select(F.lit("edge").alias("part"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "edge_type", "line_number", "file_path")).alias("json"))
    return n.unionByName(e)


def elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(group, json): elements for a browser's graph view; an edge's id is source->target."""
    n = nodes.select(F.lit("nodes").alias("group"), F.to_json(F.struct(F.struct("id", F.col("name").alias("label"), "kind", "file_path", "is_entrypoint").alias("data"))).alias("json"))
    e = edges.select(F.lit("edges").alias("group"), F.to_json(F.struct(F.struct(F.concat("src", F.lit("->"), "dst").alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), F.col("edge_type").alias("label")).alias("data"))).alias("json"))
    return n.unionByName(e)


def _quoted(c):
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(place, line): a Graphviz text in order of place."""
    # fixed values: the colours and styles; an entry point's colour goes before its kind's
    colour = F.when(F.col("is_entrypoint"), "salmon").when(F.col("kind") == "class", "lightblue").otherwise("lightgray")
    label = F.concat(F.lit('"'), F.replace(F.col("name"), F.lit('"'), F.lit('\\"')), F.lit("\\n("), F.col("kind"), F.lit(')"'))
    n = nodes.select(F.struct(F.lit(1).alias("a"), F.col("node_seq").alias("b"), F.col("id").alias("c")).alias("place"), F.concat(F.lit("  "), _quoted(F.col("id")), F.lit(" [label="), label, F.lit(", fillcolor="), colour, F.lit("];")).alias("line"))
    style = F.when(F.col("edge_type") == "IMPORTS", "dashed").when(F.col("edge_type").isin("EXTENDS", "IMPLEMENTS"), "bold").otherwise("solid")
    e = edges.select(F.struct(F.lit(2).alias("a"), F.col("edge_pos").alias("b"), F.col("src").alias("c")).alias("place"), F.concat(F.lit("  "), _quoted(F.col("src")), F.lit(" -> "), _quoted(F.col("dst")), F.lit(" [label="), _quoted(F.col("edge_type")), F.lit(", style="), style, F.lit("];")).alias("line"))
    ends = nodes.sparkSession.createDataFrame([((0, 0, ""), "digraph code {\n  node [shape=box, style=filled];"), ((3, 0, ""), "}")], "place struct<a:int,b:bigint,c:string>, line string")
    return n.unionByName(e).unionByName(ends)


def mermaid(nodes: DataFrame, edges: DataFrame, max_nodes: int = 100) -> str:
    """A flow chart of the first max_nodes nodes, grouped by file, and the edges among them."""
    first = nodes.orderBy("node_seq", "id").limit(max_nodes)
    one = Window.orderBy("node_seq", "id")  # at most max_nodes rows
    numbered = first.withColumn("n", F.row_number().over(one)).withColumn("f", F.dense_rank().over(Window.orderBy("file_path")))
    rows = numbered.select("id", "name", "file_path", "n", "f").collect()
    ids = {r["id"]: f"N{r['n']}" for r in rows}
    small = numbered.select("id")
    inside = edges.join(F.broadcast(small.withColumnRenamed("id", "src")), "src", "left_semi").join(F.broadcast(small.withColumnRenamed("id", "dst")), "dst", "left_semi").orderBy("edge_pos").limit(max_nodes * max_nodes).collect()
    out = ["graph LR"]
    for f in sorted({(r["f"], r["file_path"]) for r in rows}):
        out.append(f'  subgraph S{f[0]}["{f[1]}"]')
        out += [f'    {ids[r["id"]]}["{r["name"]}"]' for r in rows if r["f"] == f[0]]
        out.append("  end")
    out += [f"  {ids[e['src']]} -->|{e['edge_type']}| {ids[e['dst']]}" for e in inside]
    return "\n".join(out)


def first_elements(nodes: DataFrame, edges: DataFrame, max_nodes: int = 100) -> DataFrame:
    """elements() of the first max_nodes nodes and the edges among them."""
    first = nodes.orderBy("node_seq", "id").limit(max_nodes)
    ids = first.select("id")
    inside = edges.join(F.broadcast(ids.withColumnRenamed("id", "src")), "src", "left_semi").join(F.broadcast(ids.withColumnRenamed("id", "dst")), "dst", "left_semi")  # max_nodes rows
    return elements(first, inside)


def report_mermaid(report: DataFrame, shown: int = 20) -> str:
    """One impact report's target with its first upstream and downstream nodes."""
    r = report.select("root", F.slice("upstream_callers", 1, shown).alias("up"), F.slice("downstream_callees", 1, shown).alias("down")).first()
    if r is None:
        return "graph LR"
    out = ["graph LR", f'  T["{r["root"]}"]:::target']
    out += [f'  U{i}["{x}"]:::up --> T' for i, x in enumerate(r["up"])]
    out += [f'  T --> D{i}["{x}"]:::down' for i, x in enumerate(r["down"])]
    return "\n".join([*out, "  classDef target fill:#f66", "  classDef up fill:#fc6", "  classDef down fill:#6cf"])


def sarif_results(cycles: DataFrame, dead: DataFrame, violations: DataFrame) -> DataFrame:
    """(rule, level, json): a SARIF result a finding."""

    def result(rule, level, text, uri, line):
        place = F.array(F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), F.struct(line.alias("startLine")).alias("region")).alias("physicalLocation")))
        return [F.lit(rule).alias("rule"), level.alias("level"), F.to_json(F.struct(F.lit(rule).alias("ruleId"), level.alias("level"), F.struct(text.alias("text")).alias("message"), place.alias("locations"))).alias("json")]

    file_, line = F.regexp_replace("source_location", r":\d+$", ""), F.coalesce(F.regexp_extract("source_location", r":(\d+)$", 1).try_cast("int"), F.lit(1))
    a = cycles.select(*result("RG001", F.lit("error"), F.concat(F.lit("Circular dependency: "), F.array_join("nodes", " -> ")), F.element_at("nodes", 1), F.lit(1)))
    b = dead.select(*result("RG002", F.lit("warning"), F.concat(F.lit("Unreferenced "), "kind", F.lit(" "), "qualified_name"), F.col("file_path"), F.greatest(F.lit(1), F.coalesce("line_start", F.lit(1)))))
    c = violations.select(*result("RG003", F.when(F.col("severity") == "error", "error").otherwise("warning"), F.col("message"), file_, line))
    return a.unionByName(b).unionByName(c)


def _document(head: str, parts: list[tuple[DataFrame, str]], tail: str) -> DataFrame:
    """(place, line): a JSON text in order of place, of lists of objects; each list comes with the text after it."""
    spark = parts[0][0].sparkSession
    fixed, rows = [((0, 0), head)], []
    for k, (df, after) in enumerate(parts, 1):
        kept = cut(df.select("json", F.monotonically_increasing_id().alias("n")))
        first = kept.agg(F.min("n")).scalar()
        rows.append(kept.select(F.struct(F.lit(2 * k - 1).alias("a"), F.col("n").alias("b")).alias("place"), F.concat(F.when(F.col("n") == first, "").otherwise(","), "json").alias("line")))
        fixed.append(((2 * k, 0), after))
    out = spark.createDataFrame([*fixed, ((2 * len(parts) + 1, 0), tail)], "place struct<a:int,b:bigint>, line string")
    for r in rows:
        out = out.unionByName(r)
    return out


def sarif_document(results: DataFrame) -> DataFrame:
    """(place, line): a SARIF document with all results."""
    rules = [{"id": "RG001", "name": "CircularDependency"}, {"id": "RG002", "name": "DeadCode"}, {"id": "RG003", "name": "ArchitectureRule"}]
    head = json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "strandline", "rules": rules}}, "results": []}]})
    return _document(head[: -len("]}]}")], [(results, "]")], "}]}")


def json_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(place, line): one JSON object with the lists nodes and edges."""
    lines = json_lines(nodes, edges)
    return _document('{"nodes": [', [(lines.where("part = 'node'"), '], "edges": ['), (lines.where("part = 'edge'"), "]")], "}")


def write_lines(lines: DataFrame, path: str) -> None:
    """A text of (place, line) rows as files whose names are in the order of its parts."""
    lines.orderBy("place").select("line").write.mode("overwrite").text(path)


def html_report(title: str, totals: DataFrame, coupled: DataFrame, dead: DataFrame, cycles: DataFrame, reports: DataFrame, shown: DataFrame, rows: int = 100) -> str:
    """A page of tables, each of its first `rows` rows and saying of how many, with the elements of a graph view (group, json)."""

    def block(name: str, df: DataFrame) -> str:
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        name = f"{name}: {n}" if (n := df.count()) <= rows else f"{name}: the first {rows} of {n}"
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in df.limit(rows).collect())
        return f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>"

    embedded = ",".join(r["json"] for r in shown.select("json").collect()).replace("</", "<\\/")  # of at most `rows` nodes
    parts = [("Totals", totals), ("Coupling", coupled.orderBy(F.desc("ca"), "instability", "module_name")), ("Unreferenced code", dead.orderBy("file_path", "line_start")), ("Cycles", cycles), ("Impact", reports)]
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>" + "".join(block(*p) for p in parts) + f'<script type="application/json" id="elements">[{embedded}]</script>'
