"""Queries of the general training-data problems, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import heavy_keys, hierarchy, orphans
from ..session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve(hierarchy.parent_links(table(spark, d, "edges")))


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.resolve(hierarchy.parent_links(table(spark, d, "edges")), with_path=True)
    return found.select("edge_type", "node_id", "root_id", "depth", F.array_join("path", " > ").alias("path"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.resolve(hierarchy.parent_links(table(spark, d, "edges")), with_path=True))


HEAVY = (("edges", "target_id", "edge_seq"), ("blast_nodes", "node_id", "row_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [heavy_keys.heavy(table(spark, d, t), key, seq).select(F.lit(t).alias("table_name"), "key_id") for t, key, seq in HEAVY]
    return parts[0].unionByName(parts[1])


def p2_callers(spark: SparkSession, d: str) -> DataFrame:
    """Rows and distinct callers of every symbol."""
    return heavy_keys.per_key(table(spark, d, "edges"), "target_id", "source_id", row_id="edge_seq").select("key_id", "n", F.col("n_distinct").alias("callers"))


def p2_reports(spark: SparkSession, d: str) -> DataFrame:
    """Rows and distinct reports of every symbol."""
    return heavy_keys.per_key(table(spark, d, "blast_nodes"), "node_id", "report_id", row_id="row_id").select("key_id", "n", F.col("n_distinct").alias("reports"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.all_orphans(*(table(spark, d, t) for t in ("calls", "imports", "inheritance", "symbols", "runtime_symbols", "known_packages")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "ref_id", "reason").distinct()


def p6_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans.by_month(_orphans(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p2_found, p2_callers, p2_reports, p6_found, p6_by_month)}

_LINKS = r"""
links as (
  select et, node, arg_min(par, (par <> node, par)) as par from (
    select upper(regexp_replace(edge_type, '^\s+|\s+$', '', 'g')) as et,
      case when upper(regexp_replace(edge_type, '^\s+|\s+$', '', 'g')) = 'CONTAINS' then target_id else source_id end as node,
      case when upper(regexp_replace(edge_type, '^\s+|\s+$', '', 'g')) = 'CONTAINS' then source_id else target_id end as par
    from edges where source_id is not null and target_id is not null)
  where et in ('CONTAINS', 'EXTENDS') group by et, node),
tree as (
  select l.et, l.node, l.par as root, 1 as depth, [l.par, l.node] as path from links l
  where not exists (select 1 from links x where x.et = l.et and x.node = l.par)
  union all
  select l.et, l.node, t.root, t.depth + 1, list_append(t.path, l.node) from tree t join links l on l.et = t.et and l.par = t.node),
lost as (select et, node, par from links l where not exists (select 1 from tree t where t.et = l.et and t.node = l.node)),
reach as (
  select et, node as start, par as cur from lost
  union
  select r.et, r.start, l.par from reach r join lost l on l.et = r.et and l.node = r.cur)"""

_MODULE = r"""
paths as (
  select repo_id, b, e, regexp_replace(c, '/?[^/]*$', '') as folder, regexp_replace(regexp_replace(c, '^.*/', ''), '(.)\.[^.]*$', '\1') as base
  from (select repo_id, first_seen_at as b, deleted_at as e, regexp_replace(file_path, '^(\./)+', '') as c from symbols where kind = 'module')),
parted as (
  select repo_id, b, e, list_filter(regexp_split_to_array(case when base in ('__init__', 'index', 'mod') then folder else folder || '/' || base end, '::|[./]'), lambda x: x <> '') as p from paths),
spans as (
  select 'F' as space, repo_id, qualified_name as key, first_seen_at as b, deleted_at as e from symbols where kind in ('function', 'method', 'class')
  union all select 'T', repo_id, qualified_name, first_seen_at, deleted_at from symbols where kind in ('class', 'interface')
  union all select 'M', repo_id, '/' || array_to_string(p, '.'), b, e from parted
  union all select 'M', repo_id, array_to_string(p[i:], '.'), b, e from (select *, unnest(range(1, len(p) + 1)) as i from parted)),
call_names as (
  select call_id, repo_id, recorded_at, regexp_replace(regexp_replace(callee_name, '^\s+|\s+$', '', 'g'), '\?\.|::', '.', 'g') as n,
    regexp_replace(regexp_replace(coalesce(caller_id, ''), '^.*?::', ''), '(^|\.)[^.]*$', '') as scope from calls),
import_names as (
  select import_id, repo_id, recorded_at, regexp_replace(source_module, '^\s+|\s+$', '', 'g') as s, lower(file_path) like '%.py' as py,
    list_filter(string_split(regexp_replace(regexp_replace(file_path, '^(\./)+', ''), '/?[^/]*$', ''), '/'), lambda x: x not in ('', '.')) as lv from imports),
import_steps as (
  select *, regexp_extract(case when not py and s in ('.', '..') then s || '/' else s end, '^(?:\.{1,2}/)+') as sl, length(regexp_extract(s, '^\.+')) as dots from import_names i
  where s <> '' and not exists (select 1 from known_packages k where s = k.package_name or starts_with(s, k.package_name || '.') or starts_with(s, k.package_name || '/') or starts_with(s, k.package_name || '::'))),
import_keys as (
  select *, case when sl <> '' then (length(sl) - length(replace(sl, '../', ''))) // 3 when py and dots > 0 then dots - 1 end as ups,
    case when sl <> '' then case when length(s) < length(sl) then '' else s[length(sl) + 1:] end when py then regexp_replace(s, '^\.+', '') else s end as rest from import_steps),
refs as (
  select 'calls' as table_name, call_id as ref_id, repo_id, 'F' as space, recorded_at as t,
    case when regexp_matches(n, '^(self|this|cls)\.') then case when scope <> '' then scope || '.' else '' end || regexp_replace(n, '^(self|this|cls)\.', '') else n end as key from call_names
  union all
  select 'inheritance', inherit_id, repo_id, 'T', recorded_at, regexp_replace(regexp_replace(regexp_replace(regexp_replace(parent_name, '^\s+|\s+$', '', 'g'), '\?\.|::', '.', 'g'), '[<\[].*$', '', 's'), '\s+$', '') from inheritance
  union all
  select 'imports', import_id, repo_id, 'M', recorded_at,
    case when ups is null then array_to_string(list_filter(regexp_split_to_array(regexp_replace(rest, '^crate::', ''), '::|[./]'), lambda x: x <> ''), '.')
      when ups > len(lv) then '//'
      else '/' || array_to_string(list_filter(regexp_split_to_array(array_to_string(lv[1:len(lv) - ups], '/') || '/' || rest, '::|[./]'), lambda x: x <> ''), '.') end from import_keys),
misses as (
  select r.table_name, r.ref_id, r.t, case when bool_or(s.key is not null) is not true then 'missing' when bool_or(s.e <= r.t) then 'deleted' else 'late' end as reason
  from (select distinct * from refs where key is not null and key <> '') r left join spans s on s.space = r.space and s.repo_id = r.repo_id and s.key = r.key
  where not (r.space = 'F' and r.key in (select qualified_name from runtime_symbols))
    and not (r.space = 'T' and r.key in (select qualified_name from runtime_symbols where kind in ('class', 'interface')))
  group by r.table_name, r.ref_id, r.t, r.space, r.key
  having not coalesce(bool_or(s.b <= r.t and (s.e is null or s.e > r.t)), false))"""

SQL = {
    "p1_found": f"""with recursive {_LINKS}
select et as edge_type, node as node_id, root as root_id, depth from tree
union all select et, node, '', case when exists (select 1 from reach r where r.et = l.et and r.start = l.node and r.cur = l.node) then -1 else -2 end from lost l""",
    "p1_paths": f"""with recursive {_LINKS}
select et as edge_type, node as node_id, root as root_id, depth, array_to_string(path, ' > ') as path from tree
union all select et, node, '', case when exists (select 1 from reach r where r.et = l.et and r.start = l.node and r.cur = l.node) then -1 else -2 end, null from lost l""",
    "p1_descendants": f"""with recursive {_LINKS}
select et as edge_type, path[i] as ancestor_id, node as node_id, cast(depth - i + 1 as int) as distance from (select *, unnest(range(1, depth + 1)) as i from tree)""",
    "p2_found": """select 'edges' as table_name, target_id as key_id from edges where target_id is not null group by target_id having count(*) >= 0.01 * (select count(*) from edges)
union all select 'blast_nodes', node_id from blast_nodes where node_id is not null group by node_id having count(*) >= 0.01 * (select count(*) from blast_nodes)""",
    "p2_callers": "select target_id as key_id, count(*) as n, count(distinct source_id) + max(case when source_id is null then 1 else 0 end) as callers from edges where target_id is not null group by 1",
    "p2_reports": "select node_id as key_id, count(*) as n, count(distinct report_id) + max(case when report_id is null then 1 else 0 end) as reports from blast_nodes where node_id is not null group by 1",
    "p6_found": f"with {_MODULE} select distinct table_name, ref_id, reason from misses",
    "p6_by_month": f"with {_MODULE} select table_name, strftime(t, '%Y-%m') as month, reason, count(distinct ref_id) as n from misses group by all",
}
