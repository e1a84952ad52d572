import datetime as dt

from strandline.operators import orphans as o

D = lambda day: dt.datetime(2024, 1, day)
SYMBOLS = "repo_id int, qualified_name string, kind string, file_path string, first_seen_at timestamp, deleted_at timestamp"
CALLS = "call_id bigint, repo_id int, caller_id string, callee_name string, file_path string, recorded_at timestamp, key string, block int"
IMPORTS = "import_id bigint, repo_id int, source_module string, file_path string, recorded_at timestamp, range int"
INHERITS = "inherit_id bigint, repo_id int, parent_name string, recorded_at timestamp"
RUNTIME = "qualified_name string, kind string"


def find(spark, symbols=(), calls=(), imports=(), inherits=(), runtime=(), packages=()):
    tables = [spark.createDataFrame(list(x), s) for x, s in ((calls, CALLS), (imports, IMPORTS), (inherits, INHERITS), (symbols, SYMBOLS), (runtime, RUNTIME))]
    c, i, n, s, r = tables
    p = spark.createDataFrame([(x,) for x in packages], "package_name string")
    return {(x.table_name, x.ref_id): x.reason for x in o.all_orphans(c, i, n, s, r, p).collect()}


def call(i, name, day=5, caller="a.py::C.m", repo=1):
    return (i, repo, caller, name, "a.py", D(day), "k", 1)


def test_calls(spark):
    symbols = [(1, "C.m", "method", "a.py", D(2), None), (1, "f", "function", "a.py", D(1), D(3)), (1, "f", "function", "a.py", D(6), D(8)), (1, "v", "variable", "a.py", D(1), None), (2, "g", "function", "a.py", D(1), None), (1, "K", "class", "a.py", D(9), None)]
    calls = [call(1, "C.m"), call(2, " self.m "), call(3, "this?.m"), call(4, "C::m"), call(5, "f"), call(6, "f", 6), call(7, "f", 2), call(8, "g"), call(9, "v"), call(10, "K"), call(11, None), call(12, "  "), call(13, "log"), call(14, "F"), call(15, "f", 3), call(16, "self.f", 7, "a.py::f"), call(17, "C.m", repo=None)]
    got = find(spark, symbols, calls + [calls[7]], runtime=[("log", "function")])
    assert got == {("calls", 5): "deleted", ("calls", 8): "missing", ("calls", 9): "missing", ("calls", 10): "late", ("calls", 14): "missing", ("calls", 15): "deleted", ("calls", 17): "missing"}


def test_inheritance(spark):
    symbols = [(1, "A", "class", "a.py", D(1), None), (1, "I", "interface", "a.py", D(1), None), (1, "f", "function", "a.py", D(1), None)]
    rows = [(1, 1, "A<T>", D(2)), (2, 1, "I[str, int]", D(2)), (3, 1, "f", D(2)), (4, 1, "Base", D(2)), (5, 1, "rt", D(2)), (6, 1, None, D(2))]
    got = find(spark, symbols, inherits=rows, runtime=[("Base", "class"), ("rt", "function")])
    assert got == {("inheritance", 3): "missing", ("inheritance", 5): "missing"}


def test_imports(spark):
    paths = ["src/a/b.py", "src/pkg/__init__.py", "web/x/index.ts", "web/x/util.ts", "src/m/mod.rs", "src/deep/n.rs"]
    symbols = [(1, "<module>", "module", p, D(1), None) for p in paths]
    wanted = {
        1: ("a.b", "src/z.py", None), 2: ("b", "src/z.py", None), 3: (".b", "src/a/z.py", None), 4: ("..pkg", "src/a/z.py", None), 5: ("./util", "web/x/q.ts", None), 6: ("../x", "web/y/q.ts", None), 7: ("crate::m", "src/q.rs", None), 8: ("crate::deep::n", "src/q.rs", None),
        9: ("lib.sub", "src/z.py", None), 10: ("libx", "src/z.py", "missing"), 11: ("./util", "web/q.ts", "missing"), 12: ("....b", "src/a/z.py", "missing"), 13: (" a/b ", "src/z.py", None), 14: ("ab", "src/z.py", "missing"), 15: ("index", "web/x/q.ts", "missing"), 16: ("", "src/z.py", None), 17: (".", "web/x/q.ts", None), 18: ("lib::q", "src/q.rs", None), 19: ("../../../../a/b", "src/a/z.ts", "missing"),
    }
    got = find(spark, symbols, imports=[(i, 1, m, p, D(2), 3) for i, (m, p, _) in wanted.items()], packages=["lib"])
    assert got == {("imports", i): r for i, (_, _, r) in wanted.items() if r}


def test_empty_tables(spark):
    assert find(spark) == {}
    assert find(spark, calls=[call(1, "x")]) == {("calls", 1): "missing"}


def test_hot_range_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(o, "REFERENCES_PER_BLOCK", 50)
    calls = [call(i, "f", 1 + i % 5) for i in range(400)]
    got = find(spark, [(1, "f", "function", "a.py", D(3), None)], calls)
    assert got == {("calls", i): "late" for i in range(400) if i % 5 < 2}


def test_many_blocks_and_ranges_against_brute_force(spark, monkeypatch):
    import random

    monkeypatch.setattr(o, "REFERENCES_PER_BLOCK", 40)
    monkeypatch.setattr(o, "PARENTS_PER_RANGE", 15)
    r = random.Random(1)
    names = [f"n{i}" for i in range(40)]
    symbols = [(r.choice([1, 2]), r.choice(names[:30]), "function", "a.py", D(a := r.randrange(1, 25)), r.choice([None, D(a + r.randrange(1, 6))])) for _ in range(150)]
    calls = [call(i, "n0" if r.random() < 0.4 else r.choice(names), r.randrange(1, 30), repo=r.choice([1, 2])) for i in range(500)]
    want = {}
    for i, repo, _, name, _, at, *_ in calls:
        own = [(s[4], s[5]) for s in symbols if s[0] == repo and s[1] == name]
        if not any(b <= at and (e is None or at < e) for b, e in own):
            want["calls", i] = "missing" if not own else "deleted" if any(e is not None and e <= at for _, e in own) else "late"
    assert find(spark, symbols, calls) == want
