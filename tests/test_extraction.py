"""What the parsers find, by language."""

from strandline.functions.extraction import PARSERS, Parsed, parse
from strandline.operators import extract


def names(p, kind=None):
    return {s["qualified_name"]: s for s in p.symbols if kind is None or s["kind"] == kind}


def calls(p):
    return {(c["caller_id"].split("::", 1)[1], c["callee_name"]) for c in p.calls}


def test_python():
    p = parse("pkg/shop.py", "import a.b as ab\nfrom .c import d as e, f\nfrom g import *\n\n@app.get('/x')\ndef _route(a, b: int, c=1, d: str = '', *args, **kw):\n    '''Doc.'''\n    if a and b or c:\n        return ab.run(e(a))\n\nclass ShopTest(Base, m.Other, metaclass=M):\n    async def sell(self, n: Item):\n        n.pay()\n        def inner():\n            self.log()\n        return [x for x in n if x]\n\nboot()\n")
    s = names(p)
    assert s["_route"]["kind"] == "function" and s["_route"]["is_entrypoint"] and not s["_route"]["is_exported"] and s["_route"]["complexity"] == 4
    assert s["_route"]["parameters"] == ["a", "b", "c"] and s["_route"]["param_types"] == {"b": "int"} and s["_route"]["docstring"] == "Doc."
    assert s["ShopTest"]["is_entrypoint"] and s["ShopTest.sell.inner"]["kind"] == "method" and s["<module>"]["name"] == "shop"
    assert {("_route", "ab.run"), ("_route", "e"), ("ShopTest.sell", "n.pay"), ("ShopTest.sell.inner", "self.log"), ("<module>", "boot"), ("<module>", "n.pay")} <= calls(p)
    assert {(i["source_module"], i["imported_name"], i["alias"], i["is_wildcard"]) for i in p.imports} == {("a.b", "b", "ab", False), (".c", "d", "e", False), (".c", "f", None, False), ("g", "*", None, True)}
    assert [x["parent_name"] for x in p.inheritance] == ["Base", "m.Other"]


def test_python_that_does_not_parse_keeps_its_module():
    assert list(names(parse("a.py", "def f(:"))) == ["<module>"]


def test_script():
    p = parse("src/user.ts", "import D, { a as b, type C } from './x';\nimport * as ns from 'y';\nexport interface User extends Base { id: number }\nexport class Svc<T> extends Base<T> implements I1, I2 {\n  private n = make(1);\n  async get(id: string): Promise<User> { if (id && this.n) { return api.load(id); } return new User(); }\n}\nexport const handler = async (e, { f }) => { run(e); };\nfunction testIt(x) { const q = require('lib/q'); return q ? x : null }\nstart();\n")
    s = names(p)
    assert {k: v["kind"] for k, v in s.items()} == {"<module>": "module", "User": "interface", "Svc": "class", "Svc.get": "method", "handler": "function", "testIt": "function"}
    assert s["handler"]["is_entrypoint"] and s["testIt"]["is_entrypoint"] and s["Svc.get"]["is_exported"] and s["Svc.get"]["complexity"] == 2 and s["Svc.get"]["parameters"] == ["id"]
    assert {("Svc.get", "api.load"), ("handler", "run"), ("<module>", "start")} <= calls(p)
    assert not any(c == "User" for _, c in calls(p))
    assert {(i["source_module"], i["imported_name"], i["alias"]) for i in p.imports} == {("./x", "D", None), ("./x", "a", "b"), ("./x", "C", None), ("y", "*", "ns"), ("lib/q", "q", None)}
    assert {(x["parent_name"], x["relation"]) for x in p.inheritance} == {("Base", "EXTENDS"), ("I1", "IMPLEMENTS"), ("I2", "IMPLEMENTS")}


def test_java():
    p = parse("App.java", "package com.x;\nimport a.b.C;\nimport d.e.*;\npublic class App extends Base implements I {\n  App(int n) { super(n); }\n  @GetMapping(\"/x\")\n  public String run(String id, int[] xs) { if (id == null) { return null; } svc.load(id); return new Other().go(); }\n  interface In extends J, K { void m(); }\n}\n")
    s = names(p)
    assert set(s) == {"<package:com.x>", "App", "App.App", "App.run", "App.In", "App.In.m"}
    assert s["App.run"]["is_entrypoint"] and s["App.run"]["complexity"] == 2 and s["App.run"]["is_exported"] and not s["App.App"]["is_exported"]
    assert ("App.run", "svc.load") in calls(p)
    assert {(i["source_module"], i["imported_name"]) for i in p.imports} == {("a.b", "C"), ("d", "e")}
    assert {(x["child_id"].split("::")[1], x["parent_name"], x["relation"]) for x in p.inheritance} == {("App", "Base", "EXTENDS"), ("App", "I", "IMPLEMENTS"), ("App.In", "J", "EXTENDS"), ("App.In", "K", "EXTENDS")}


def test_go():
    p = parse("svc/o.go", "package svc\n\nimport (\n\t\"fmt\"\n\tx \"a/b\"\n)\n\ntype Order struct { id int }\n\ntype Repo interface { Get() }\n\nfunc (o *Order) Cancel(reason string, n, m int) error {\n\tif n > 0 { fmt.Println(reason) }\n\treturn x.Do()\n}\n\nfunc main() { Run() }\n")
    s = names(p)
    assert {k: v["kind"] for k, v in s.items()} == {"<package:svc>": "module", "Order": "class", "Repo": "interface", "Order.Cancel": "method", "main": "function"}
    assert s["Order.Cancel"]["complexity"] == 2 and s["Order.Cancel"]["param_types"]["reason"] == "string" and s["main"]["is_entrypoint"]
    assert {("Order.Cancel", "fmt.Println"), ("Order.Cancel", "x.Do"), ("main", "Run")} == calls(p)
    assert {(i["source_module"], i["imported_name"], i["alias"]) for i in p.imports} == {("fmt", "fmt", None), ("a/b", "x", "x")}


def test_rust():
    p = parse("src/calc.rs", "use crate::engine::Engine;\nuse a::b as c;\npub struct Calc<'a> { x: &'a f64 }\npub trait Shape { fn area(&self); }\nimpl<'a> Shape for Calc<'a> {\n    fn area(&self) { if self.ok() { calc.run(1) } }\n}\nimpl<'a> Calc<'a> {\n    pub fn new(val: &f64, mut n: u8) -> Self { Engine::new(val) }\n}\nfn main() { println!(\"x\"); }\n")
    s = names(p)
    assert {k: v["kind"] for k, v in s.items()} == {"<module>": "module", "Calc": "class", "Shape": "interface", "Calc.area": "method", "Calc.new": "method", "main": "function"}
    assert s["Calc.new"]["param_types"] == {"val": "f64", "n": "u8"} and s["Calc.new"]["is_exported"] and s["Calc.area"]["complexity"] == 2
    assert {("Calc.area", "self.ok"), ("Calc.area", "calc.run"), ("Calc.new", "Engine::new")} == calls(p)
    assert [(x["child_id"].split("::")[1], x["parent_name"], x["relation"]) for x in p.inheritance] == [("Calc", "Shape", "IMPLEMENTS")]
    assert {(i["source_module"], i["imported_name"], i["alias"]) for i in p.imports} == {("crate::engine", "Engine", None), ("a", "b", "c")}


def test_unknown_broken_and_own_languages():
    assert parse("a.txt", "x") is None
    for ext in ("js", "java", "go", "rs", "py"):
        assert len(parse(f"a.{ext}", "'unterminated `").symbols) == 1
        assert len(parse(f"a.{ext}", "").symbols) == 1
    PARSERS["rust"], kept = lambda path, text: Parsed(), PARSERS["rust"]
    assert parse("a.rs", "fn f() { }").symbols == []
    PARSERS["rust"] = kept


def test_tables(spark):
    df = spark.createDataFrame([(1, "./a.py", "def f():\n    g()\n", 0), (1, "b.txt", "x", 0), (2, "c.go", None, 0)], "repo_id int, file_path string, content string, symbols int")
    t = extract.tables(extract.extract(df))
    assert {r.id for r in t["symbols"].collect()} == {"a.py::<module>", "a.py::f", "c.go::<module>"}
    assert [(r.caller_id, r.callee_name, r.file_path) for r in t["calls"].where("caller_id like '%::f'").collect()] == [("a.py::f", "g", "a.py")]
    assert t["symbols"].select("symbol_seq").distinct().count() == 3
