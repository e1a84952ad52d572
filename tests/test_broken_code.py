"""What the extracted_ queries make of code that does not parse: every file counts, with all that it holds."""

from strandline.functions.extraction import parse
from strandline.plans import io

JAVA = "package p;\nimport a.b.C;\n\npublic class A extends B implements I {\n    void run(List<Object> all) {\n        all.forEach(x -> helper(x"


def calls(p):
    return [(c["caller_id"].split("::", 1)[1], c["callee_name"], c["line_number"]) for c in p.calls]


def spans(p):
    return {s["qualified_name"]: (s["line_start"], s["line_end"]) for s in p.symbols if s["kind"] != "module"}


def query(spark, tmp_path, name, *files):
    rows = [(i, 1, path, "java", text) for i, (path, text) in enumerate(files)]
    spark.createDataFrame(rows, "file_id int, repo_id int, file_path string, language string, content string").write.parquet(str(tmp_path / "parsed_files.parquet"))
    return io.QUERIES[name](spark, str(tmp_path)).collect()


def test_calls_of_a_method_that_the_text_breaks_off(spark, tmp_path):
    assert calls(parse("A.java", JAVA)) == [("A.run", "all.forEach", 6), ("A.run", "helper", 6)]
    rows = query(spark, tmp_path, "extracted_calls", ("A.java", JAVA), ("D.java", "class D { void f() { g(); } }"))
    assert {(r.caller_id, r.callee_name) for r in rows} == {("A.java::A.run", "all.forEach"), ("A.java::A.run", "helper"), ("D.java::D.f", "g")}


def test_imports_of_a_text_that_breaks_off(spark, tmp_path):
    assert [i["source_module"] for i in parse("a.js", "import x from 'y';\nconst q = 1;\nfunction").imports] == ["y"]
    rows = query(spark, tmp_path, "extracted_imports", ("A.java", JAVA), ("D.java", "import d.E;\nclass D { void f("), ("e.rs", "use m::n;\nfn f(mut: T) {}"))
    assert {(r.file_path, r.source_module, r.imported_name) for r in rows} == {("A.java", "a.b", "C"), ("D.java", "d", "E"), ("e.rs", "m", "n")}


def test_symbols_where_brackets_do_not_match(spark, tmp_path):
    # one that is missing within the text ends with its indentation, one that is too many ends nothing
    assert spans(parse("A.java", "class A {\n    void f() {\n        if (x) {\n            g();\n    }\n    void h() {\n        k(1;\n    }\n}\n")) == {"A": (1, 9), "A.f": (2, 5), "A.h": (6, 8)}
    assert spans(parse("a.rs", "struct S {\n    x: u8,\nfn f() {\n    g();\n}\nfn h() {\n}\n")) == {"S": (1, 2), "f": (3, 5), "h": (6, 7)}
    conflict = "class A {\n    void f() {\n<<<<<<< HEAD\n        if (a) {\n=======\n        if (b) {\n>>>>>>> main\n        }\n        g();\n    }\n    void h() {\n    }\n}\n"
    assert spans(parse("A.java", conflict)) == {"A": (1, 13), "A.f": (2, 10), "A.h": (11, 12)}
    rows = query(spark, tmp_path, "extracted_symbols", ("A.java", JAVA), ("a.js", "function"), ("b.rs", "fn f(mut: T) {}"))
    assert {(r.id, r.line_start, r.line_end) for r in rows if r.kind != "module"} >= {("A.java::A", 4, 6), ("A.java::A.run", 5, 6), ("b.rs::f", 1, 1)}


def test_symbols_of_deep_and_odd_texts(spark, tmp_path):
    assert len(parse("A.java", "class A{" * 2000).symbols) == 2001
    assert len(parse("a.py", "x = " + "-" * 200_000 + "1").symbols) == 1
    rows = query(spark, tmp_path, "extracted_symbols", ("a.py", 'def f():\n    """\\ud800"""\n'), ("b.java", "class B {" * 600))
    assert len(rows) == 603 and parse("a.py", 'def f():\n    """\\ud800"""\n').symbols[1]["docstring"] == "\\ud800"


def test_inheritance_of_a_text_that_breaks_off(spark, tmp_path):
    rows = query(spark, tmp_path, "extracted_inheritance", ("A.java", JAVA), ("D.java", "class D extends A { void f("))
    assert {(r.child_id, r.parent_name, r.relation) for r in rows} == {("A.java::A", "B", "EXTENDS"), ("A.java::A", "I", "IMPLEMENTS"), ("D.java::D", "A", "EXTENDS")}


def test_graph_of_a_text_that_breaks_off(spark, tmp_path):
    rows = query(spark, tmp_path, "extracted_graph", ("A.java", JAVA), ("H.java", "class H {\n    void helper() {\n    }\n}\n"))
    assert any("A.java::A.run" in r and "H.java::H.helper" in r for r in map(tuple, rows))
