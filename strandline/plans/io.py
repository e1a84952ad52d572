"""Queries of sources, extraction, streams and exports over the given tables, and the SQL of those that have one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cycles, graph, link, quality
from ..operators.extract import extract, linked, tables
from ..session import cut, table
from ..sources import export, scan
from ..streaming import watch
from . import reference


def _files(spark, d):
    return table(spark, d, "parsed_files").dropDuplicates(["file_id"])


def extracted_symbols(spark, d):
    return tables(extract(_files(spark, d), ["symbols"]))["symbols"].select("repo_id", "id", "kind", "line_start", "line_end", "is_exported", "is_entrypoint", "complexity")


def extracted_imports(spark, d):
    return tables(extract(_files(spark, d), ["imports"]))["imports"].drop("import_id")


def extracted_calls(spark, d):
    return tables(extract(_files(spark, d), ["calls"]))["calls"].drop("call_id")


def extracted_inheritance(spark, d):
    return tables(extract(_files(spark, d), ["inheritance"]))["inheritance"].drop("inherit_id")


def extracted_graph(spark, d):
    """Edges linked from what the files themselves hold."""
    files = _files(spark, d)
    parts = tables(cut(linked(files)))
    edges = link.build_extracted(files, *(parts[p] for p in ("symbols", "imports", "calls", "inheritance", "contained")))
    return edges.select("repo_id", "dst", "src", "edge_type", "line_number")


def content_hash(spark, d):
    return table(spark, d, "parsed_files").select("file_id", F.sha2("content", 256).alias("content_hash")).distinct()


def discovered_files(spark, d):
    """Files that a scan of their repository would look at."""
    rows = table(spark, d, "parsed_files").select("file_id", "file_path").distinct()
    return scan.discover(rows.select("file_id", F.concat(F.lit("/root/"), F.regexp_replace("file_path", r"^(\./)+", "")).alias("path")), "/root").select("file_id", "file_path", "language")


def cache_diff(spark, d):
    """Files of unchanged and of new content, against a cache that holds those scanned before 2025."""
    files = table(spark, d, "parsed_files").select("repo_id", "file_id", "file_path", "content_hash", "scanned_at").distinct()
    hits, misses = scan.split_by_cache(files, files.where("scanned_at < '2025-01-01'"))
    return hits.select("file_id", F.lit(True).alias("cached")).unionByName(misses.select("file_id", F.lit(False).alias("cached")))


def snapshot_differences(spark, d):
    """Changes between the files scanned before 2025 and all."""
    files = table(spark, d, "parsed_files").groupBy("file_path").agg(F.min("scanned_at").alias("first"), F.max("scanned_at").alias("last"))
    return watch.differences(files.where("first < '2025-01-01'").select("file_path", F.col("first").alias("modified")), files.select("file_path", F.col("last").alias("modified")))


def event_windows(spark, d):
    return watch.windowed_counts(table(spark, d, "events"))


def event_sessions(spark, d):
    return watch.sessions(table(spark, d, "events"))


def browser_elements(spark, d):
    return export.elements(*reference._graph(spark, d))


def dot_lines(spark, d):
    return export.dot_lines(*reference._graph(spark, d)).select("line")


def sarif_results(spark, d):
    nodes, edges = reference._kept(spark, d)
    return export.sarif_results(cycles.cycles(cut(cycles.file_graph(nodes, edges))), quality.dead_code(nodes, edges), quality.forbidden(nodes, edges, reference.RULES))


NAMES = "extracted_symbols extracted_imports extracted_calls extracted_inheritance extracted_graph content_hash discovered_files cache_diff snapshot_differences event_windows event_sessions browser_elements dot_lines sarif_results".split()
QUERIES = {n: globals()[n] for n in NAMES}

SQL = {
    "content_hash": "select distinct file_id, sha256(content) as content_hash from parsed_files",
    "discovered_files": r"""with f as (select distinct file_id, regexp_replace(file_path, '^(\./)+', '') as file_path from parsed_files),
e as (select *, lower(regexp_extract(file_path, '\.([^./]+)$', 1)) as ext, string_split(file_path, '/') as p from f)
select file_id, file_path, case when ext = 'py' then 'python' when ext in ('js', 'jsx', 'mjs', 'cjs') then 'javascript' when ext in ('ts', 'tsx') then 'typescript' when ext = 'java' then 'java' when ext = 'go' then 'go' when ext = 'rs' then 'rust' end as language from e
where ext in ('py', 'js', 'jsx', 'mjs', 'cjs', 'ts', 'tsx', 'java', 'go', 'rs') and p[-1] not in ('.DS_Store', 'Thumbs.db')
  and len(list_filter(p[1:len(p) - 1], lambda x: starts_with(x, '.') or x in ('venv', 'env', 'node_modules', 'target', 'build', 'dist', '__pycache__', 'out', 'bin'))) = 0""",
    "cache_diff": """with f as (select distinct repo_id, file_id, file_path, content_hash, scanned_at from parsed_files)
select file_id, exists (select 1 from f g where g.repo_id = f.repo_id and g.file_path = f.file_path and g.content_hash = f.content_hash and g.scanned_at < timestamp '2025-01-01') as cached from f""",
    "snapshot_differences": """with f as (select file_path, min(scanned_at) as a, max(scanned_at) as b from parsed_files group by file_path)
select file_path, case when a >= timestamp '2025-01-01' then 'added' else 'changed' end as op from f where a >= timestamp '2025-01-01' or b > a""",
    "event_windows": "select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2",
    "event_sessions": """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) as k from g)
select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as n from s group by user_id, k""",
}
