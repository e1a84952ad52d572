"""SQL of the queries in reference, for DuckDB."""

from __future__ import annotations

from .reference import EVERY

_NODES = r"""
own as (
  select id, min(symbol_seq) as node_seq, arg_max({'name': name, 'qualified_name': qualified_name, 'kind': kind, 'file_path': file_path, 'line_start': line_start, 'line_end': line_end, 'is_exported': is_exported, 'is_entrypoint': is_entrypoint, 'complexity': complexity}, symbol_seq) as a
  from symbols where id is not null group by id),
nodes as (
  select id, node_seq, a.name as name, a.qualified_name as qualified_name, a.kind as kind, a.file_path as file_path, a.line_start as line_start, a.line_end as line_end, a.is_exported as is_exported, a.is_entrypoint as is_entrypoint, a.complexity as complexity from own
  union all
  select id, -1, name, qualified_name, kind, file_path, null, null, true, false, 1 from runtime_symbols where id not in (select id from own))"""
_UPSERT = r"""
upserted as (
  select source_id as src, target_id as dst, min(edge_seq) as edge_pos, arg_max({'t': upper(regexp_replace(edge_type, '^\s+|\s+$', '', 'g')), 'l': line_number, 'f': file_path}, edge_seq) as a
  from edges where source_id is not null and target_id is not null group by all),
flat as (select src, dst, edge_pos, a.t as edge_type, a.l as line_number, a.f as file_path from upserted)"""
_GRAPH = f"""{_NODES},{_UPSERT},
links as (select * from flat where src in (select id from nodes) and dst in (select id from nodes))"""
_ROOTS = f"""{_GRAPH},
roots as (select id as root, node_seq from nodes where node_seq >= 0 and kind <> 'module' and node_seq % {EVERY} = 0)"""


def _walk(name: str, types: str, near: str, far: str, depth: int) -> str:
    return f"""
{name}_all as (
  select root, root as node, 0 as depth from roots
  union
  select w.root, l.{far}, w.depth + 1 from {name}_all w join links l on l.{near} = w.node where w.depth < {depth} and l.edge_type in ({types})),
{name} as (select root, node, min(depth) as depth from {name}_all group by root, node having min(depth) > 0)"""


def _first(name: str, types: str, near: str, far: str, depth: int) -> str:
    """The first way to each node that a search in the order of the edges finds."""
    return f"""
{name}_all as (
  select root, root as node, 0 as depth, {{'way': []::bigint[], 'path': [root]}} as best from roots
  union all
  select w.root, l.{far}, w.depth + 1, min({{'way': list_append(w.best.way, l.edge_pos), 'path': list_append(w.best.path, l.{far})}}) from {name}_all w join links l on l.{near} = w.node
  where w.depth < {depth} and l.edge_type in ({types}) group by w.root, l.{far}, w.depth),
{name}_one as (select root, node, min(depth) as depth, arg_min(best, depth) as best from {name}_all group by root, node having min(depth) > 0)"""


def _half_even(x: str) -> str:
    """x on one decimal, half to even, by its decimal digits as Spark does, not by its binary value."""
    d = f"cast(cast({x} as varchar) as decimal(30, 15)) * 10"
    return f"((floor({d}) + case when {d} - floor({d}) > 0.5 or {d} - floor({d}) = 0.5 and floor({d}) % 2 = 1 then 1 else 0 end) / 10)::double"


_IMPACT, _EFFECT = "'CALLS', 'IMPORTS', 'EXTENDS', 'IMPLEMENTS'", "'CALLS', 'EXTENDS', 'IMPLEMENTS'"
_CATEGORY = """case when lower(file_path) like '%test%' or starts_with(lower(name), 'test_') then 'TEST'
  when coalesce(is_entrypoint, false) or regexp_matches(lower(file_path), 'controller|route|api|cli|handler') then 'CRITICAL'
  when kind in ('class', 'interface') or regexp_matches(lower(file_path), 'service|model|domain|repository') then 'HIGH' else 'MEDIUM' end"""
_BLAST = f"""{_ROOTS},{_walk('up', _IMPACT, 'dst', 'src', 10)},{_walk('down', _EFFECT, 'src', 'dst', 10)},
reached as (
  select r.root, r.direction, r.node as node_id, r.depth, n.name, n.file_path, {_CATEGORY} as category
  from (select root, 'up' as direction, node, depth from up union all select root, 'down', node, depth from down) r join nodes n on n.id = r.node)"""
_MODULE = "case when regexp_replace(file_path, '/?[^/]*$', '') <> '' then regexp_replace(file_path, '/?[^/]*$', '') else regexp_replace(file_path, '(.)\\.[^.]*$', '\\1') end"
_COUPLING = f"""{_GRAPH},
mods as (select id, {_MODULE} as m from nodes where file_path is not null and file_path <> ''),
across as (select s.m as sm, t.m as tm from links l join mods s on s.id = l.src join mods t on t.id = l.dst where l.edge_type in ('CALLS', 'IMPORTS') and s.m <> t.m),
coupled as (
  select m as module_name, ca, ce, case when ca + ce > 0 then round_even(ce / (ca + ce), 2) else 0.0 end as instability from (
    select m, (select count(*) from across where tm = m) as ca, (select count(*) from across where sm = m) as ce from (select distinct m from mods)))"""
_FILES = f"""{_GRAPH},
pairs as (
  select distinct s.file_path as src, t.file_path as dst from links l join nodes s on s.id = l.src join nodes t on t.id = l.dst
  where l.edge_type in ('CALLS', 'IMPORTS') and s.file_path <> '' and t.file_path <> '' and s.file_path <> t.file_path)"""
_CALLS = f"""{_GRAPH},
pairs as (
  select distinct src, dst from links where edge_type = 'CALLS' and src <> dst and src in (select id from nodes where kind <> 'module') and dst in (select id from nodes where kind <> 'module'))"""
_PAIRS = f"""{_ROOTS},{_walk('below', _IMPACT, 'src', 'dst', 10)},
ends_ as (select r.root as source, coalesce(arg_max(b.node, (b.depth, b.node)), r.root) as target from roots r left join below b on b.root = r.root group by r.root)"""
_SHORTEST = f"""{_PAIRS},{_first('down', _IMPACT, 'src', 'dst', 12)},
found as (
  select e.source, e.target, d.depth as total_hops, d.best.path as path from ends_ e join down_one d on d.root = e.source and d.node = e.target where e.source <> e.target
  union all select source, target, 0, [source] from ends_ where source = target)"""
_CYCLES = """,
two as (select 2 as length, [a.src, a.dst, a.src] as nodes from pairs a join pairs b on b.src = a.dst and b.dst = a.src where a.src < a.dst),
three as (
  select 3 as length, [a.src, a.dst, b.dst, a.src] as nodes from pairs a join pairs b on b.src = a.dst join pairs c on c.src = b.dst and c.dst = a.src
  where a.src < a.dst and a.src < b.dst and a.dst <> b.dst),
picked as (select * from two union all select * from three where (select count(*) from two) < 100)
select length, array_to_string(nodes, ' > ') as nodes from (select * from picked order by length, nodes limit 100)"""
_CLOSED = """,
far as (select src, dst from pairs union select f.src, p.dst from far f join pairs p on p.src = f.dst)"""
_RINGS = f"""{_CLOSED},
ring as (select p.src, p.dst from pairs p join far f on f.src = p.dst and f.dst = p.src),
walks as (
  select src as start, dst as node, [src, dst] as nodes from ring where dst > src
  union all select w.start, r.dst, list_append(w.nodes, r.dst) from walks w join ring r on r.src = w.node where r.dst > w.start and not list_contains(w.nodes, r.dst)),
closed as (select len(w.nodes) as length, list_append(w.nodes, w.start) as nodes from walks w join ring r on r.src = w.node and r.dst = w.start)
select cast(length as int) as length, array_to_string(nodes, ' > ') as nodes from (select * from closed order by length, nodes limit 100)"""
_LINES = """
hunks as (select coalesce(repo_id::varchar, '') || ':' || file_path as diff_id, file_path, line_number as l from calls where line_number > 0 and file_path is not null),
changed as (select distinct diff_id, file_path, l + i as line from hunks, (values (0), (1)) t(i))"""
_SYMBOLS = """
rows_ as (select repo_id, id, name, qualified_name, kind, file_path, symbol_seq as node_seq from symbols where id is not null),
mods as (select repo_id, file_path, arg_min(id, node_seq) as module_id from rows_ where kind = 'module' group by all)"""
_FORBIDDEN = f"""{_GRAPH},
ends as (select l.src, l.dst, l.line_number, s.file_path as sf, t.file_path as tf from links l join nodes s on s.id = l.src join nodes t on t.id = l.dst where l.edge_type in ('IMPORTS', 'CALLS')),
broken as (
  select *, 'error' as severity, 'Forbidden dependency from ' || sf || ' to ' || tf as message from ends
  where (sf glob 'src/*/handlers/*' or sf = 'src/*/handlers' or starts_with(sf, 'src/*/handlers/')) and (tf glob 'src/*/models/*')
  union all
  select *, 'warning', 'shared code must not know billing' from ends where starts_with(sf, 'src/shared/') and starts_with(tf, 'src/billing/')),
violations as (select 'forbidden' as rule_type, src, dst, sf || ':' || case when coalesce(line_number, 0) = 0 then 1 else line_number end as source_location, tf as target_location, message, severity from broken)"""

_UNSTABLE = """select module_name, instability, 0.5 as max_i from coupled where (module_name = 'src/shared' or starts_with(module_name, 'src/shared/')) and instability > 0.5
union all select module_name, instability, 0.6 from coupled where (module_name = 'internal' or starts_with(module_name, 'internal/')) and instability > 0.6"""
_ALL_BROKEN = f"""{_FORBIDDEN},{_COUPLING.removeprefix(_GRAPH + ",")},
broken_all as (
  select rule_type, source_location, target_location, message, severity from violations
  union all select 'instability', module_name, null, printf('Module %s has instability %.2f over %.2f', module_name, instability::double, max_i::double), 'error' from ({_UNSTABLE})
  union all select 'complexity', file_path || ':' || coalesce(line_start, 1), null, printf('%s has complexity %d over %d', id, complexity, 20), 'warning' from nodes where kind in ('function', 'method') and complexity > 20)"""
SQL = {
    "blast_upstream": f"with recursive {_ROOTS},{_walk('w', _IMPACT, 'dst', 'src', 10)} select root, node as node_id, depth from w",
    "blast_downstream": f"with recursive {_ROOTS},{_walk('w', _EFFECT, 'src', 'dst', 10)} select root, node as node_id, depth from w",
    "blast_category": f"with recursive {_BLAST} select root, direction, node_id, depth, category from reached",
    "blast_score": f"""with recursive {_BLAST},
sizes as (
  select t.root, count(*) filter (r.direction = 'up') as up, count(*) filter (r.direction = 'down') as down,
    count(distinct case when r.direction = 'up' and r.category = 'CRITICAL' then r.name || ' (' || r.file_path || ')' end) as entrypoints,
    count(distinct case when r.direction = 'up' and r.category = 'TEST' then r.name || ' (' || r.file_path || ')' end) as tests
  from roots t left join reached r on r.root = t.root group by t.root),
spread as (select root, count(distinct f) as files from (select root, file_path as f from reached union all select r.root, n.file_path from roots r join nodes n on n.id = r.root) group by root)
select root, up, down, entrypoints, files, tests, up + down as total_impacted,
  greatest(case when up > 0 or down > 0 then 1.0 else 0.0 end, least(100.0, round_even((4.0 * up + 1.5 * down + 20.0 * entrypoints + 5.0 * files)::double * case when tests > 0 then greatest(0.6, 1.0 - 0.08 * tests) else 1.25 end, 1)))::double as score
from sizes join spread using (root)""",
    "symbol_search": f"""with {_NODES},
scored as (select *, case when lower(name) = 'ledger' then 100 when lower(qualified_name) like '%ledger%' then 80 when lower(name) like '%ledger%' then 60 when lower(file_path) like '%ledger%' then 40 else 0 end as match_score from nodes where kind <> 'module')
select id, name, qualified_name, kind, file_path, match_score from scored where match_score > 0 order by match_score desc, name, node_seq, id limit 50""",
    "resolve_target": f"""with {_NODES},
queries as (select distinct callee_name as query from calls where callee_name is not null),
exact as (select query, query as id from queries where query in (select id from nodes)),
keys as (
  select id, node_seq, file_path, name as key from nodes where kind <> 'module'
  union
  select id, node_seq, file_path, array_to_string(p[i:], '.') from (select *, unnest(range(1, len(p) + 1)) as i from (select *, string_split(qualified_name, '.') as p from nodes where kind <> 'module')))
select query, id from exact union all
select query, arg_min(id, (t, node_seq, id)) as id from (select q.query, k.id, k.node_seq, lower(k.file_path) like '%test%' as t from queries q join keys k on k.key = trim(q.query) where q.query not in (select query from exact)) group by query""",
    "filter_list": f"with {_NODES} select id, qualified_name, kind, file_path from nodes where lower(qualified_name) like '%voucher%' or lower(file_path) like '%voucher%' order by qualified_name, node_seq, id limit 100",
    "source_preview": r"""with own as (select id, arg_max({'kind': kind, 'file_path': file_path, 's': line_start, 'e': line_end}, symbol_seq) as a from symbols where id is not null group by id),
texts as (select regexp_replace(file_path, '^(\./)+', '') as file_path, string_split(regexp_replace(min(content), '\r\n?', chr(10), 'g'), chr(10)) as l from parsed_files group by parsed_files.file_path)
select id, a.s as line_start, a.e as line_end, md5(array_to_string(l[greatest(a.s, 1):greatest(a.s, 1) + a.e - a.s], chr(10))) as source_md5 from own join texts on texts.file_path = a.file_path where a.e >= a.s""",
    "dead_code": f"""with {_GRAPH} select id, name, qualified_name, kind, file_path, line_start, line_end, complexity from nodes
where kind not in ('module', 'variable') and not coalesce(lower(file_path) like '%test%' or starts_with(name, 'test_') or ends_with(name, 'Test') or (starts_with(name, '__') and ends_with(name, '__'))
    or name in ('main', 'handler', 'app', 'cli', 'setUp', 'tearDown', 'init') or is_entrypoint or (is_exported and (ends_with(file_path, '__init__.py') or ends_with(file_path, 'index.ts'))), false)
  and id not in (select dst from links where edge_type in ({_IMPACT}))""",
    "repo_totals": f"""with {_GRAPH} select (select count(distinct file_path) from nodes) as total_files, count(*) filter (kind <> 'module') as total_symbols, round_even(sum(case when kind <> 'module' then complexity else 0 end) / greatest(1, count(*) filter (kind <> 'module')), 2) as avg_complexity,
  (select count(*) from links) as total_edges from nodes""",
    "repo_metrics": f"""with {_FILES},
dead as (select id from nodes where kind not in ('module', 'variable') and not coalesce(lower(file_path) like '%test%' or starts_with(name, 'test_') or ends_with(name, 'Test') or (starts_with(name, '__') and ends_with(name, '__'))
    or name in ('main', 'handler', 'app', 'cli', 'setUp', 'tearDown', 'init') or is_entrypoint or (is_exported and (ends_with(file_path, '__init__.py') or ends_with(file_path, 'index.ts'))), false)
  and id not in (select dst from links where edge_type in ({_IMPACT}))),
rings as (select * from ({_CYCLES.removeprefix(",").replace("two as", "with two as", 1)}))
select (select count(distinct file_path) from nodes) as total_files, count(*) filter (kind <> 'module') as total_symbols, round_even(sum(case when kind <> 'module' then complexity else 0 end) / greatest(1, count(*) filter (kind <> 'module')), 2) as avg_complexity,
  (select count(*) from links) as total_edges, (select count(*) from rings) as cycles_count, (select count(*) from dead) as dead_symbols_count from nodes""",
    "language_histogram": f"with {_NODES} select regexp_extract(file_path, '[^/](\\.[^./]*)$', 1) as extension, count(*) as n from nodes group by 1",
    "coupling": f"with {_COUPLING} select * from coupled",
    "bottlenecks": f"""with {_GRAPH} select n.id, n.name, count(*) as in_degree from links l join nodes n on n.id = l.dst where l.edge_type in ('CALLS', 'IMPORTS') and n.kind in ('function', 'method', 'class')
group by n.id, n.name, n.node_seq order by in_degree desc, n.node_seq, n.id limit 10""",
    "lint_forbidden": f"with {_FORBIDDEN} select * from violations",
    "lint_violations": f"with {_ALL_BROKEN} select * from broken_all",
    "lint_counts": f"with {_ALL_BROKEN} select count(*) as total, count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings from broken_all",
    "lint_instability": f"with {_COUPLING} {_UNSTABLE}",
    "lint_complexity": f"with {_NODES} select id, file_path, line_start, complexity from nodes where kind in ('function', 'method') and complexity > 20",
    "file_graph": f"with {_FILES} select * from pairs",
    "module_cycles": f"with {_FILES}{_CYCLES}",
    "symbol_cycles": f"with recursive {_CALLS}{_RINGS}",
    "file_components": f"with recursive {_FILES}{_CLOSED} select f.src as node, least(f.src, min(f.dst)) as component from far f join far b on b.src = f.dst and b.dst = f.src where f.src <> f.dst group by f.src",
    "blast_paths": f"""with recursive {_ROOTS},{_first('up', _IMPACT, 'dst', 'src', 10)},{_first('down', _EFFECT, 'src', 'dst', 10)}
select root, 'up' as direction, node as node_id, depth, array_to_string(list_reverse(best.path), ' > ') as path from up_one
union all select root, 'down', node, depth, array_to_string(list_reverse(best.path), ' > ') from down_one""",
    "shortest_path_hops": f"with recursive {_SHORTEST} select source, target, total_hops from found",
    "path_result": f"""with recursive {_SHORTEST},
steps as (select source, target, unnest(range(1, len(path))) as hop, path from found)
select s.source, s.target, cast(s.hop as int) as hop, s.path[s.hop] as src, s.path[s.hop + 1] as dst, l.edge_type, l.line_number, a.name as from_name, a.file_path as from_file, b.name as to_name, b.file_path as to_file
from steps s join links l on l.src = s.path[s.hop] and l.dst = s.path[s.hop + 1] join nodes a on a.id = l.src join nodes b on b.id = l.dst""",
    "simple_paths": f"""with recursive {_PAIRS},
walks as (
  select source, target, source as node, [source] as path from ends_
  union all select w.source, w.target, l.dst, list_append(w.path, l.dst) from walks w join links l on l.src = w.node
  where len(w.path) <= 8 and l.edge_type in ('CALLS', 'IMPORTS') and not list_contains(w.path, l.dst) and w.node <> w.target or len(w.path) = 1 and l.edge_type in ('CALLS', 'IMPORTS') and not list_contains(w.path, l.dst)),
done as (select source, target, cast(len(path) - 1 as int) as hops, path, row_number() over (partition by source, target order by len(path), path) as k from walks where node = target and len(path) > 1)
select source, target, hops, array_to_string(path, ' > ') as path from done where k <= 5""",
    "blast_report": f"""with recursive {_ROOTS},{_first('up', _IMPACT, 'dst', 'src', 10)},{_first('down', _EFFECT, 'src', 'dst', 10)},
reached as (
  select r.root, r.direction, r.node, r.depth, r.best.way as way, n.name, n.file_path, {_CATEGORY} as category
  from (select *, 'up' as direction from up_one union all select *, 'down' from down_one) r join nodes n on n.id = r.node),
sized as (
  select t.root, n.name as target_name, n.file_path as target_file, count(*) filter (r.direction = 'up') as up, count(*) filter (r.direction = 'down') as down,
    list_sort(list_distinct(list_append(coalesce(list(r.file_path) filter (r.file_path is not null), []), n.file_path))) as files,
    coalesce(list_sort(list(distinct r.name || ' (' || r.file_path || ')') filter (r.direction = 'up' and r.category = 'CRITICAL')), []) as points,
    coalesce(list_sort(list(distinct r.name || ' (' || r.file_path || ')') filter (r.direction = 'up' and r.category = 'TEST')), []) as tests,
    coalesce(list(r.node order by r.depth, r.name, r.way, r.node) filter (r.direction = 'up'), []) as callers, coalesce(list(r.node order by r.depth, r.name, r.way, r.node) filter (r.direction = 'down'), []) as callees
  from roots t join nodes n on n.id = t.root left join reached r on r.root = t.root group by t.root, n.name, n.file_path)
select root, target_name, target_file, up, down, up + down as total_impacted, array_to_string(files, ' ; ') as affected_files, array_to_string(points, ' ; ') as affected_entrypoints, array_to_string(tests, ' ; ') as affected_tests,
  array_to_string(callers, ' ; ') as upstream_callers, array_to_string(callees, ' ; ') as downstream_callees,
  greatest(case when up > 0 or down > 0 then 1.0 else 0.0 end, least(100.0, round_even((4.0 * up + 1.5 * down + 20.0 * len(points) + 5.0 * len(files))::double * case when len(tests) > 0 then greatest(0.6, 1.0 - 0.08 * len(tests)) else 1.25 end, 1)))::double as score
from sized""",
    "edge_upsert": f"with {_UPSERT} select src, dst, edge_pos, edge_type, line_number from flat",
    "contains_edges": f"""with {_SYMBOLS},
one as (select repo_id, id, arg_max({{'q': qualified_name, 'k': kind, 'f': file_path}}, node_seq) as a from rows_ where kind <> 'module' group by all),
wanted as (select repo_id, id, a.q as q, a.k as k, a.f as f from one where (a.q like '%.%') = (a.k = 'method'))
select w.repo_id, coalesce(p.id, m.module_id, w.f || '::<module>') as src, w.id as dst from wanted w
left join (select distinct repo_id, id from rows_) p on p.repo_id = w.repo_id and w.k = 'method' and p.id = w.f || '::' || regexp_replace(w.q, '\\.[^.]*$', '')
left join mods m on m.repo_id = w.repo_id and m.file_path = w.f""",
    "inheritance_link": f"""with {_SYMBOLS},
classes as (select * from rows_ where kind in ('class', 'interface')),
one as (select distinct inherit_id, repo_id, child_id, regexp_replace(parent_name, '^.*\\.', '') as parent, relation, regexp_replace(file_path, '^(\\./)+', '') as f from inheritance where parent_name is not null and child_id is not null)
select inherit_id, src, dst, edge_type from (
  select o.inherit_id, o.child_id as src, o.relation as edge_type,
    coalesce((select arg_min(c.id, c.node_seq) from classes c where c.repo_id = o.repo_id and c.name = o.parent and c.file_path = o.f), (select arg_min(c.id, c.node_seq) from classes c where c.repo_id = o.repo_id and c.name = o.parent)) as dst from one o)
where dst is not null""",
    "diff_hunks": f"with {_LINES} select * from changed",
    "diff_interval_join": f"""with {_LINES},
own as (select id, arg_max({{'kind': kind, 'f': file_path, 's': line_start, 'e': line_end}}, symbol_seq) as a from symbols where id is not null group by id)
select distinct diff_id, id from changed c join own on own.a.f = c.file_path and c.line between own.a.s and own.a.e where own.a.kind <> 'module'""",
    "ego_subgraph": f"""with recursive {_ROOTS},
above as (select root, root as node, 0 as k from roots union select a.root, l.src, a.k + 1 from above a join links l on l.dst = a.node where a.k < 2),
upper as (select distinct root, node from above),
one as (select distinct r.root, l.dst as node from roots r join links l on l.src = r.root where not exists (select 1 from upper u where u.root = r.root and u.node = l.dst)),
two_ as (select distinct o.root, l.dst as node from one o join links l on l.src = o.node where not exists (select 1 from upper u where u.root = o.root and u.node = l.dst) and not exists (select 1 from one u where u.root = o.root and u.node = l.dst)),
held as (select * from upper union select * from one union select * from two_)
select distinct a.root, l.src, l.dst, l.edge_type from links l join held a on a.node = l.src join held b on b.node = l.dst and b.root = a.root""",
    "diff_aggregate": f"""with recursive {_GRAPH},{_LINES},
touched as (select distinct c.diff_id, n.id from changed c join nodes n on n.file_path = c.file_path and c.line between n.line_start and n.line_end where n.kind <> 'module'),
roots as (select distinct id as root from touched),{_walk('up', _IMPACT, 'dst', 'src', 10)},{_walk('down', _EFFECT, 'src', 'dst', 10)},
reached as (
  select r.root, r.direction, r.node, n.name, n.file_path, {_CATEGORY} as category
  from (select root, 'up' as direction, node from up union all select root, 'down', node from down) r join nodes n on n.id = r.node),
sizes as (
  select t.root, count(*) filter (r.direction = 'up') as up, count(*) filter (r.direction = 'down') as down,
    count(distinct case when r.direction = 'up' and r.category = 'CRITICAL' then r.name || ' (' || r.file_path || ')' end) as points, count(distinct case when r.direction = 'up' and r.category = 'TEST' then r.name || ' (' || r.file_path || ')' end) as tests
  from roots t left join reached r on r.root = t.root group by t.root),
spread as (select root, count(distinct f) as files from (select root, file_path as f from reached union all select r.root, n.file_path from roots r join nodes n on n.id = r.root) group by root),
scored as (
  select root, greatest(case when up > 0 or down > 0 then 1.0 else 0.0 end, least(100.0, round_even((4.0 * up + 1.5 * down + 20.0 * points + 5.0 * files)::double * case when tests > 0 then greatest(0.6, 1.0 - 0.08 * tests) else 1.25 end, 1)))::double as score
  from sizes join spread using (root)),
most as (select diff_id, count(*) as symbols, max(score) as highest from touched join scored on scored.root = touched.id group by diff_id),
met as (select diff_id, count(*) as total_impacted from (select diff_id, id from touched union select t.diff_id, r.node from touched t join reached r on r.root = t.id) group by diff_id)
select d.diff_id, coalesce(symbols, 0) as symbols, coalesce(case when symbols > 1 then least(100.0, {_half_even('highest * (1 + 0.1::double * symbols)')}) else highest end, 0)::double as score, coalesce(total_impacted, 0) as total_impacted
from (select distinct diff_id from changed) d left join most using (diff_id) left join met using (diff_id)""",
    "dot_lines": f"""with {_GRAPH}
select '  "' || replace(id, '"', '\\"') || '" [label="' || replace(name, '"', '\\"') || '\\n(' || kind || ')", fillcolor=' || case when is_entrypoint then 'salmon' when kind = 'class' then 'lightblue' else 'lightgray' end || '];' as line from nodes
union all select '  "' || replace(src, '"', '\\"') || '" -> "' || replace(dst, '"', '\\"') || '" [label="' || replace(edge_type, '"', '\\"') || '", style=' || case when edge_type = 'IMPORTS' then 'dashed' when edge_type in ('EXTENDS', 'IMPLEMENTS') then 'bold' else 'solid' end || '];' from links
union all select 'digraph code {{' || chr(10) || '  node [shape=box, style=filled];' union all select '}}'""",
}
