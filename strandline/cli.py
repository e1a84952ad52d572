"""python -m strandline.cli COMMAND --dir DIR: the analyses of one source tree.

Commands: scan, blast-radius SYMBOL, cycles, dead-code, metrics, path SOURCE TARGET, diff, lint, search TEXT, watch, report,
export FORMAT (mermaid, json, dot, sarif, html). Rows are printed as JSON lines, all of them, or written to --output.
What was extracted is kept in .strandline below the tree and reused for unchanged files, unless --no-cache is given.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import changes, cycles, graph, impact, link, quality, search, traverse
from .operators.extract import extract, tables
from .session import cut, local_session
from .sources import config, export
from .sources.scan import extract_cached, scan
from .streaming import watch

SHOWN = {"coupling": 15, "bottlenecks": 10, "report": 100}


def load(spark, root: str, settings: config.ScanConfig, use_cache: bool = True) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of a source tree."""
    files = cut(scan(spark, root, 0, settings.max_file_size_bytes, ignored_dirs=settings.ignored_dirs, ignored_files=settings.ignored_files))
    if use_cache and settings.enable_cache:
        extracted = extract_cached(spark, files, os.path.join(root, ".strandline", "extracted"))
    else:
        extracted = cut(extract(files))
    parts = {k: cut(v) for k, v in tables(extracted).items()}
    nodes = graph.vertices(parts["symbols"])
    edges = link.build(files, parts["symbols"], parts["imports"], parts["calls"], parts["inheritance"])
    numbered = edges.withColumn("edge_pos", F.xxhash64("src", "dst")).withColumn("file_path", F.regexp_extract("src", r"^(.*?)::", 1))
    return cut(nodes), cut(numbered)


def _write(args: argparse.Namespace, lines: Iterable[str]) -> None:
    """Lines to the file --output, or to the screen, one at a time."""
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.writelines(x + "\n" for x in lines)
    else:
        for x in lines:
            print(x)


def _text(lines: DataFrame) -> Iterable[str]:
    return (r["line"] for r in lines.orderBy("place").toLocalIterator())


def _diff(args: argparse.Namespace, settings: config.ScanConfig, spark, nodes: DataFrame, edges: DataFrame) -> int:
    lines = cut(changes.parse_diff(config.git_diff(spark, args.dir, args.base, args.staged)))
    scored = cut(changes.impact(lines, nodes, edges))
    touched = changes.touched(lines, nodes).join(nodes, "id").select("qualified_name", "kind", "file_path", "line_start").orderBy("file_path", "line_start")
    rows = scored.collect()  # one row a diff, and there is one diff
    if args.format == "json":
        _write(args, (json.dumps({**r.asDict(True), "modified": [t.asDict() for t in touched.collect()]}, default=str) for r in rows))
    else:
        mark = "## " if args.format == "markdown" else ""
        out = []
        for r in rows:
            out += [f"{mark}Impact of the changes since {r['diff_id']}", *(f"- {k}: {v}" for k, v in (("Score", f"{r['score']}/100"), ("Symbols modified", r["symbols"]), ("Symbols reached", r["total_impacted"]), ("Files", len(r["affected_files"])), ("Entry points", len(r["affected_entrypoints"])), ("Tests", len(r["affected_tests"]))))]
        out += ["", f"{mark and '### '}Symbols modified", *(f"- {t['qualified_name']} ({t['kind']}, {t['file_path']}:{t['line_start']})" for t in touched.toLocalIterator())]
        points = [p for r in rows for p in r["affected_entrypoints"]]
        _write(args, out + (["", f"{mark and '### '}Entry points", *(f"- {p}" for p in points)] if points else []))
    limit = args.max_risk if args.max_risk is not None else settings.rules.max_risk
    return int(limit is not None and not changes.gate(scored, limit).isEmpty())


def run(args: argparse.Namespace, spark=None) -> int:
    spark = spark or local_session()
    settings = config.load(args.dir)
    graph_of = lambda: load(spark, args.dir, settings, not args.no_cache)
    nodes, edges = graph_of()
    named = lambda *texts: {r["query"]: r["id"] for r in search.resolve(nodes, spark.createDataFrame([(t,) for t in texts], "query string"), args.command != "path").collect()}
    show = lambda *dfs: _write(args, (json.dumps(r.asDict(True), default=str) for df in dfs for r in df.toLocalIterator()))
    rings = lambda: cycles.cycles(cycles.file_graph(nodes, edges))
    if args.command == "scan":
        show(quality.metrics(nodes, edges, rings(), quality.dead_code(nodes, edges)))
    elif args.command == "blast-radius":
        found = named(args.rest[0])
        if not found:
            return 1
        show(impact.reports(nodes, edges, spark.createDataFrame([(x,) for x in found.values()], "root string"), args.depth))
    elif args.command == "cycles":
        show(rings())
    elif args.command == "dead-code":
        show(quality.dead_code(nodes, edges, args.include_exported).orderBy("file_path", "line_start"))
    elif args.command == "metrics":
        show(quality.metrics(nodes, edges, rings(), quality.dead_code(nodes, edges)), quality.languages(nodes), quality.coupling(nodes, edges).orderBy(F.desc("ca"), "instability", "module_name").limit(SHOWN["coupling"]), quality.bottlenecks(nodes, edges, SHOWN["bottlenecks"]))
    elif args.command == "path":
        found = named(*args.rest[:2])
        if len(found) < len(set(args.rest[:2])):
            return 1
        paths = traverse.shortest_paths(edges, spark.createDataFrame([(found[args.rest[0]], found[args.rest[1]])], "source string, target string"), graph.IMPACT)
        if paths.isEmpty():
            return 1
        show(traverse.hops(paths, edges, nodes).orderBy("hop"))
    elif args.command == "diff":
        return _diff(args, settings, spark, nodes, edges)
    elif args.command == "lint":
        broken = cut(quality.violations(nodes, edges, settings.rules.forbidden, settings.rules.instability, settings.rules.max_complexity))
        show(broken)
        return int(not broken.where("severity = 'error'").isEmpty())
    elif args.command == "search":
        show(search.find_symbols(nodes, args.rest[0]))
    elif args.command == "watch":
        left = [args.polls]

        def changed(differences, nodes, edges):
            for r in [*differences.toLocalIterator(), *quality.totals(nodes, edges).toLocalIterator()]:
                print(json.dumps(r.asDict(True), default=str), flush=True)
            left[0] -= 1

        query = watch.watch_graph(spark, args.dir, graph_of, changed)
        while query.isActive and left[0] != 0:
            query.awaitTermination(1)
        query.stop()
    elif args.command in ("export", "report"):
        kind = "html" if args.command == "report" else args.rest[0] if args.rest else "mermaid"
        if kind == "json":
            _write(args, _text(export.json_document(nodes, edges)))
        elif kind == "dot":
            _write(args, _text(export.dot_lines(nodes, edges)))
        elif kind == "mermaid":
            _write(args, [export.mermaid(nodes, edges)])
        elif kind == "sarif":
            _write(args, _text(export.sarif_document(export.sarif_results(rings(), quality.dead_code(nodes, edges), quality.violations(nodes, edges, settings.rules.forbidden, settings.rules.instability, settings.rules.max_complexity)))))
        elif kind == "html":
            first = nodes.where("kind <> 'module'").orderBy("node_seq", "id").limit(SHOWN["report"]).select(F.col("id").alias("root"))
            reports = impact.reports(nodes, edges, cut(first)).select("root", "score", "up", "down")
            _write(args, [export.html_report(args.title or args.dir, quality.metrics(nodes, edges, cut(rings()), quality.dead_code(nodes, edges)), quality.coupling(nodes, edges), quality.dead_code(nodes, edges), rings(), reports, export.first_elements(nodes, edges), SHOWN["report"])])
        else:
            return 1
    else:
        return 2
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="strandline", description=__doc__)
    p.add_argument("command")
    p.add_argument("rest", nargs="*")
    p.add_argument("--dir", default=".")
    p.add_argument("--depth", type=int, default=10)
    p.add_argument("--include-exported", action="store_true")
    p.add_argument("--base", default="HEAD~1")
    p.add_argument("--staged", action="store_true")
    p.add_argument("--max-risk", type=float)
    p.add_argument("--format", choices=["text", "markdown", "json"], default="text")
    p.add_argument("--no-cache", action="store_true")
    p.add_argument("--output")
    p.add_argument("--title")
    p.add_argument("--polls", type=int, default=-1, help="changes after which watch ends; without it, it goes on")
    return run(p.parse_args(argv), spark)


if __name__ == "__main__":
    sys.exit(main())
