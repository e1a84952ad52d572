"""Traversal, impact, cycles, linking and rules against plain Python on small graphs."""

import random
from itertools import permutations

from strandline.functions.globs import matches
from strandline.operators import changes, cycles, graph, impact, link, quality, search, traverse

NODE = "id string, node_seq bigint, name string, qualified_name string, kind string, file_path string, line_start int, line_end int, docstring string, is_exported boolean, is_entrypoint boolean, complexity int"
EDGE = "src string, dst string, edge_pos bigint, edge_type string, line_number int, file_path string"


def node(i, path="m.py", kind="function", name=None, entry=False, lines=(1, 9), exported=True, complexity=1):
    return (f"{path}::{i}", 0, name or i.rpartition(".")[2], i, kind, path, *lines, "", exported, entry, complexity)


def small(spark):
    nodes = [node("a", "src/api/x.py", entry=True), node("b", "src/service/y.py"), node("c", "src/z.py"), node("test_d", "tests/t.py"), node("e", "src/z.py", "class"), node("lone", "src/z.py")]
    ids = {n[3]: n[0] for n in nodes}
    edges = [("a", "b", "CALLS"), ("b", "c", "CALLS"), ("test_d", "b", "CALLS"), ("c", "e", "EXTENDS"), ("b", "e", "IMPORTS"), ("e", "c", "CONTAINS")]
    rows = [(ids[s], ids[d], i, t, i, None) for i, (s, d, t) in enumerate(edges)]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(rows, EDGE), ids


def test_reach_against_breadth_first(spark):
    r = random.Random(7)
    pairs = {(f"n{r.randrange(25)}", f"n{r.randrange(25)}"): None for _ in range(60)}
    rows = [(s, d, i, r.choice(["CALLS", "IMPORTS", "CONTAINS"]), 1, None) for i, (s, d) in enumerate(pairs)]
    edges = spark.createDataFrame(rows, EDGE).repartition(3)
    roots = spark.createDataFrame([("n0",), ("n1",), ("n2",), ("nowhere",)], "root string")
    got = {(x.root, x.node): x.path for x in traverse.reach(edges, roots, 6, ("CALLS", "IMPORTS"), True).collect()}
    want = {}
    for root in ("n0", "n1", "n2"):
        seen, queue, paths = {root}, [root], {root: [root]}
        while queue:
            cur = queue.pop(0)
            if len(paths[cur]) > 6:
                continue
            for s, d, _, t, *_ in rows:
                if d == cur and t != "CONTAINS" and s not in seen:
                    seen.add(s)
                    paths[s] = [*paths[cur], s]
                    queue.append(s)
        want |= {(root, n): p for n, p in paths.items() if n != root}
    assert got == want  # depths and, by the order of edges, the very parents of a queue


def test_impact(spark):
    nodes, edges, ids = small(spark)
    roots = spark.createDataFrame([(ids["c"],), (ids["lone"],)], "root string")
    got = {r.root: r for r in impact.reports(nodes, edges, roots).collect()}
    c = got[ids["c"]]
    assert c.upstream_callers == [ids["b"], ids["a"], ids["test_d"]] and c.downstream_callees == [ids["e"]]
    assert (c.up, c.down, len(c.affected_files), c.affected_entrypoints, c.affected_tests) == (3, 1, 4, ["a (src/api/x.py)"], ["test_d (tests/t.py)"])
    assert c.score == round((12 + 1.5 + 20 + 20) * 0.92, 1) == 49.2
    assert got[ids["lone"]].score == 6.2 and got[ids["lone"]].total_impacted == 0
    paths = {r.node_id: r.path_from_target for r in impact.impact_paths(nodes, edges, roots).where("direction = 'up'").collect()}
    assert paths[ids["a"]] == [ids["a"], ids["b"], ids["c"]]


def test_paths(spark):
    nodes, edges, ids = small(spark)
    pairs = spark.createDataFrame([(ids["a"], ids["e"]), (ids["a"], ids["a"]), (ids["e"], ids["a"])], "source string, target string")
    got = {(r.source, r.target): r.total_hops for r in traverse.shortest_paths(edges, pairs, graph.IMPACT).collect()}
    assert got == {(ids["a"], ids["e"]): 2, (ids["a"], ids["a"]): 0}
    hop = traverse.hops(traverse.shortest_paths(edges, pairs, graph.IMPACT), edges, nodes).orderBy("hop").collect()
    assert [(h.from_name, h.to_name, h.edge_type) for h in hop] == [("a", "b", "CALLS"), ("b", "e", "IMPORTS")]


def test_simple_paths(spark):
    rows = [(s, d, i, "CALLS", 1, None) for i, (s, d) in enumerate(permutations("abcd", 2))]
    edges = spark.createDataFrame(rows, EDGE)
    pairs = spark.createDataFrame([("a", "b")], "source string, target string")
    got = [("".join(r.path)) for r in sorted(traverse.simple_paths(edges, pairs, ("CALLS",), 8, 50).collect(), key=lambda r: (r.hops, r.path))]
    assert got == ["ab", "acb", "adb", "acdb", "adcb"]
    assert traverse.simple_paths(edges, pairs, ("CALLS",), 8, 2).count() == 2
    assert traverse.simple_paths(edges, pairs, ("IMPORTS",), 8).count() == 0


def test_registered_paths_and_diffs_go_as_deep_as_the_operators(spark, monkeypatch):
    from strandline.plans import reference

    rows = [node(f"n{i:02d}", f"f{i:02d}.py", lines=(1, 2)) for i in range(14)]
    nodes = spark.createDataFrame(rows, NODE)
    ids = [x[0] for x in rows]
    edges = spark.createDataFrame([(a, b, i, "CALLS", 1, None) for i, (a, b) in enumerate(zip(ids, ids[1:]))], EDGE)
    monkeypatch.setattr(reference, "_kept", lambda spark, d: (nodes, edges))
    monkeypatch.setattr(reference, "_pairs", lambda nodes, edges: spark.createDataFrame([(ids[0], ids[13]), (ids[0], ids[5])], "source string, target string"))
    monkeypatch.setattr(reference, "_diffs", lambda spark, d: spark.createDataFrame([(1, "diff --git a/f12.py b/f12.py\n@@ -1 +1,1 @@\n+x")], "diff_id int, text string"))
    assert {(r.target, r.total_hops) for r in reference.shortest_path_hops(spark, "").collect()} == {(ids[13], 13), (ids[5], 5)}
    assert [(r.target, r.hops) for r in reference.simple_paths(spark, "").collect()] == [(ids[5], 5)]
    assert [r.total_impacted for r in reference.diff_aggregate(spark, "").collect()] == [1 + 10 + 1]


def test_ego(spark):
    nodes, edges, ids = small(spark)
    got = {(r.src, r.dst) for r in traverse.ego(edges, spark.createDataFrame([(ids["b"],)], "root string"), 1, 1).collect()}
    assert got == {(ids[a], ids[b]) for a, b in (("a", "b"), ("b", "c"), ("test_d", "b"), ("c", "e"), ("b", "e"), ("e", "c"))}


def brute_components(pairs, names):
    to = {n: {n} for n in names}
    for _ in names:
        for s, d in pairs:
            to[s] |= to[d]
    return {n: min(m for m in names if m in to[n] and n in to[m]) for n in names if any(m != n and m in to[n] and n in to[m] for m in names)}


def test_components_and_cycles(spark):
    r = random.Random(3)
    names = [f"n{i:02d}" for i in range(18)]
    pairs = sorted({(r.choice(names), r.choice(names)) for _ in range(30)})
    df = spark.createDataFrame(pairs, "src string, dst string")
    assert {x.node: x.component for x in cycles.components(df).collect()} == brute_components(pairs, names)
    want = sorted((n, [*p, p[0]]) for n in (2, 3, 4) for p in permutations(names, n) if p[0] == min(p) and all((p[i], p[(i + 1) % n]) in pairs for i in range(n)))
    got = [(x.length, x.nodes) for x in cycles.cycles(df, 1000, 4).collect()]
    assert got == want
    assert [(x.length, x.nodes) for x in cycles.cycles(df, 3, 4).collect()] == want[:3]
    assert cycles.cycles(df.where("false")).count() == 0


def test_cycles_of_any_length_are_registered(spark, monkeypatch):
    from strandline.plans import io, reference

    ids = [f"f{i:02d}.py::f" for i in range(14)]
    rows = [(x, i, "f", "f", "function", x.split("::")[0], 1, 2, False, False, 1) for i, x in enumerate(ids)]
    nodes = spark.createDataFrame(rows, "id string, node_seq bigint, name string, qualified_name string, kind string, file_path string, line_start int, line_end int, is_exported boolean, is_entrypoint boolean, complexity int")
    pairs = [*zip(ids, ids[1:] + ids[:1]), (ids[8], ids[5])]  # a ring of fourteen, and one of four in it
    edges = spark.createDataFrame([(a, b, "CALLS", i, 1, None) for i, (a, b) in enumerate(pairs)], "src string, dst string, edge_type string, edge_pos bigint, line_number int, file_path string")
    monkeypatch.setattr(reference, "_kept", lambda spark, d: (nodes, edges))
    ring, files = [*ids, ids[0]], [x.split("::")[0] for x in ids]
    assert [(r.length, r.nodes) for r in reference.symbol_cycles(spark, "").collect()] == [(4, " > ".join([*ids[5:9], ids[5]])), (14, " > ".join(ring))]
    assert [(r.length, r.nodes) for r in reference.module_cycles(spark, "").collect()] == [(4, " > ".join([*files[5:9], files[5]])), (14, " > ".join([*files, files[0]]))]
    assert sum("RG001" in str(r) for r in io.sarif_results(spark, "").collect()) == 2


def test_quality(spark):
    nodes, edges, ids = small(spark)
    assert {r.name for r in quality.dead_code(nodes, edges).collect()} == {"lone"}
    got = {r.module_name: (r.ca, r.ce, r.instability) for r in quality.coupling(nodes, edges).collect()}
    assert got == {"src/api": (0, 1, 1.0), "src/service": (2, 2, 0.5), "src": (2, 0, 0.0), "tests": (0, 1, 1.0)}
    assert [(r.name, r.in_degree) for r in quality.bottlenecks(nodes, edges).collect()][0] == ("b", 2)
    rules = [{"from": "src/service/*", "to": "src/z*"}, {"from": "nothing/**", "to": "*"}]
    broken = quality.forbidden(nodes, edges, rules).collect()
    assert sorted(r.source_location for r in broken) == ["src/service/y.py:1", "src/service/y.py:4"]
    assert quality.forbidden(nodes, edges, []).count() == 0
    assert [r.module_name for r in quality.unstable(quality.coupling(nodes, edges), [{"module": "src/*", "max_i": 0.4}]).orderBy("module_name").collect()] == ["src/api", "src/service"]


def test_globs(spark):
    df = spark.createDataFrame([("src/a/b.py",), ("src",), ("/src/x",), ("lib/src/x",), ("src+a",), ("a[1].py",)], "p string")
    from pyspark.sql import functions as F

    hit = lambda pat: {r.p for r in df.where(matches(F.col("p"), pat)).collect()}
    assert hit("src/*") == {"src/a/b.py", "src", "/src/x"} == hit("src/**")
    assert hit("*.py") == {"src/a/b.py", "a[1].py"} and hit("src?a") == {"src+a"} and hit("a[[]1].py") == {"a[1].py"}


def test_changes(spark):
    nodes, edges, ids = small(spark)
    text = "diff --git a/src/z.py b/src/z.py\n@@ -1,0 +3,2 @@ def\n+x\n@@ -9 +20,0 @@\ndiff --git a/o b/src/service/y.py\n@@ -1 +9 @@\ndiff --git a/n b/none\n"
    changed = changes.parse_diff(spark.createDataFrame([("d", text), ("e", "")], "diff_id string, text string"))
    assert {(r.file_path, r.line) for r in changed.collect()} == {("src/z.py", 3), ("src/z.py", 4), ("src/z.py", 20), ("src/service/y.py", 9)}
    assert {r.id for r in changes.touched(changed, nodes).collect()} == {ids[x] for x in ("c", "e", "lone", "b")}
    scored = changes.impact(changed, nodes, edges).first()
    assert scored.symbols == 4 and scored.score == min(100.0, scored.score) and scored.total_impacted == 6
    assert changes.gate(changes.impact(changed, nodes, edges), 10).count() == 1


def test_search(spark):
    nodes = spark.createDataFrame([node("A.cancel", kind="method"), node("cancel_all"), node("x", "cancel.py"), node("<module>", kind="module", name="cancel")], NODE)
    assert [(r.name, r.match_score) for r in search.find_symbols(nodes, " Cancel ").collect()] == [("cancel", 100), ("cancel_all", 80), ("x", 40)]
    assert search.find_symbols(nodes, "", limit=2).count() == 2 and search.find_symbols(nodes, "cancel", "method").count() == 1
    two = spark.createDataFrame([node("f", "tests/a.py"), node("f", "src/b.py"), node("K.g", "src/b.py")], NODE)
    asked = spark.createDataFrame([("f",), ("K.g",), ("g",), ("none",), ("tests/a.py::f",)], "query string")
    assert {r.query: r.id for r in search.resolve(two, asked).collect()} == {"f": "src/b.py::f", "K.g": "src/b.py::K.g", "g": "src/b.py::K.g", "tests/a.py::f": "tests/a.py::f"}


def test_upsert(spark):
    rows = [(5, "a", "b", "CALLS ", 1, "x"), (2, "a", "b", "imports", 2, "y"), (9, "a", "b", "Extends", 3, "z"), (1, None, "b", "CALLS", 1, "x"), (1, "b", "a", None, 1, "x")]
    df = spark.createDataFrame(rows, "edge_seq bigint, source_id string, target_id string, edge_type string, line_number int, file_path string")
    got = {(r.src, r.dst): (r.edge_pos, r.edge_type, r.line_number) for r in graph.upsert_edges(df).collect()}
    assert got == {("a", "b"): (2, "EXTENDS", 3), ("b", "a"): (1, None, 1)}


def test_call_rules(spark):
    symbols = [(1, f"{p}::{q}", q.rpartition(".")[2], q, k, p, t, i) for i, (p, q, k, t) in enumerate([
        ("a.py", "<module>", "module", {}), ("a.py", "A", "class", {}), ("a.py", "A.m", "method", {"svc": "x.Svc"}), ("a.py", "A.n", "method", {}), ("a.py", "h", "function", {}), ("b.py", "Svc", "class", {}), ("b.py", "Svc.go", "method", {}), ("b.py", "Svc.only", "method", {}), ("c.py", "Orders.pay", "method", {}), ("c.py", "uniq", "function", {}), ("c.py", "dup", "function", {}), ("b.py", "dup", "function", {}), ("b.py", "imported", "function", {}),
    ])]
    calls = ["self.n", "h", "A.n", "svc.go", "S.only", "orders.pay", "uniq", "dup", "imp", "nope", "A.m", None]
    names = ["repo_id int, id string, name string, qualified_name string, kind string, file_path string, param_types map<string,string>, symbol_seq bigint", "call_id bigint, repo_id int, caller_id string, callee_name string, line_number int, file_path string", "import_id bigint, repo_id int, source_module string, imported_name string, alias string, line_number int, is_wildcard boolean, file_path string"]
    s = spark.createDataFrame(symbols, names[0])
    c = spark.createDataFrame([(i, 1, "a.py::A.m", x, 1, "a.py") for i, x in enumerate(calls)], names[1])
    m = spark.createDataFrame([(1, 1, "b", "Svc", "S", 1, False, "a.py"), (2, 1, "b", "imported", "imp", 1, False, "a.py")], names[2])
    got = {calls[r.call_id]: (r.dst, r.rule) for r in link.call_edges(c, m, s).collect()}
    assert got == {
        "self.n": ("a.py::A.n", "sibling"), "h": ("a.py::h", "local name"), "A.n": ("a.py::A.n", "local qualified name"), "svc.go": ("b.py::Svc.go", "typed receiver"), "S.only": ("b.py::Svc.only", "imported member"), "orders.pay": ("c.py::Orders.pay", "similar class"), "uniq": ("c.py::uniq", "unique name"), "imp": ("b.py::imported", "imported name"),
    }
    files = spark.createDataFrame([(1, "a.py"), (1, "b.py"), (1, "pkg/__init__.py"), (1, "src/deep/x_util.py"), (1, "web/i/index.ts")], "repo_id int, file_path string")
    wanted = {"b": "b.py", "pkg": "pkg/__init__.py", "deep.x_util": "src/deep/x_util.py", "../q/x_util": "src/deep/x_util.py", "util": "src/deep/x_util.py", "web.i": "web/i/index.ts", ".b": "b.py", "zzz": None}
    i = spark.createDataFrame([(k, 1, w, "n", None, 1, False, "a.py") for k, w in enumerate(wanted)], names[2])
    assert {list(wanted)[r.import_id]: r.target_file for r in link.resolve_imports(i, files).collect()} == {k: v for k, v in wanted.items() if v}


def test_depths_against_brute_force_with_hubs(spark, monkeypatch):
    import random

    monkeypatch.setattr(traverse, "HOT_LEAST", 5)
    r = random.Random(3)
    pairs = {(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(90)} | {(f"n{i}", "n0") for i in range(20)}
    edges = spark.createDataFrame([(a, b, i, "CALLS", 1, "f") for i, (a, b) in enumerate(sorted(pairs))], "src string, dst string, edge_pos bigint, edge_type string, line_number int, file_path string")
    roots = [f"n{i}" for i in range(0, 40, 7)]
    want = {}
    for name, up in (("up", True), ("down", False)):
        for root in roots:
            seen, level = {root}, [root]
            for depth in range(1, 4):
                level = sorted({(a if up else b) for a, b in pairs for x in level if (b if up else a) == x} - seen)
                seen |= set(level)
                want |= {(name, root, x): depth for x in level}
    got = {(x.direction, x.root, x.node): x.depth for x in traverse.depths(edges, spark.createDataFrame([(x,) for x in roots], "root string"), 3, {"up": (("CALLS",), True), "down": (None, False)}).collect()}
    assert got == want


def test_scores_are_those_of_the_reports(spark):
    nodes = graph.vertices(spark.createDataFrame([(f"f{i % 3}.py::n{i}", i, f"n{i}", f"n{i}", "function", f"f{i % 3}.py" if i % 4 else "tests/f.py", 1, 2, None, True, i % 5 == 0, 1) for i in range(12)], "id string, symbol_seq bigint, name string, qualified_name string, kind string, file_path string, line_start int, line_end int, docstring string, is_exported boolean, is_entrypoint boolean, complexity int"))
    ids = [f"f{i % 3}.py::n{i}" for i in range(12)]
    edges = spark.createDataFrame([(ids[i], ids[(i * 5 + 1) % 12], i, "CALLS", 1, "f") for i in range(12)], "src string, dst string, edge_pos bigint, edge_type string, line_number int, file_path string")
    roots = spark.createDataFrame([(x,) for x in ids[:6]], "root string")
    a = {r.root: (r.up, r.down, r.score, r.files, r.entrypoints, r.tests) for r in impact.scores(impact.impact_nodes(nodes, edges, roots), nodes, roots).collect()}
    b = {r.root: (r.up, r.down, r.score, len(r.affected_files), len(r.affected_entrypoints), len(r.affected_tests)) for r in impact.reports(nodes, edges, roots).collect()}
    assert a == b and len(a) == 6
