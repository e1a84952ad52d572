"""The graph of extracted files: as of the plain tables, and without more rows shuffled than it has use for."""

from strandline.operators import link
from strandline.operators.extract import extract, linked, tables
from strandline.plans import io

FILES = [
    (1, "src/a.py", "from b import Base, helper as h\nfrom . import c\nimport os\nimport src.c\n\nclass A(Base):\n    def run(self, x: Tool):\n        self.stop()\n        h()\n        x.turn()\n        os.getcwd()\n    def stop(self):\n        tool.turn()\nA()\ndef once(): pass\n"),
    (1, "./src/b.py", "class Base:\n    class Inner:\n        def deep(self): helper()\ndef helper(): once()\n"),
    (1, "src/c/__init__.py", "from b import *\nfrom d import x\nfrom c import c\nclass Tool:\n    def turn(self): Tool()\n    class A: pass\ndef f():\n    def g(): pass\n"),
    (1, "src/d.md", "text"),
    (1, "lib/e/index.ts", "import { Part } from '../f';\nexport class E extends Part { go() { this.go(); part.stop(); } }\nfunction E() {}\n"),
    (1, "lib/f.ts", "export class Part { stop() { } }\nimport x from 'lib/f';\n"),
    (2, "g.rs", "use h::K;\nimpl K for Other { fn a(&self) { b() } }\nfn b() {}\nstruct Own {}\nimpl Own { fn c(&self) { self.c(); K::c() } }\n"),
    (2, "h.rs", "pub trait K {}\n"),
    (2, "k.go", "package k\nimport \"h\"\ntype T struct{}\nfunc (t *T) M() { t.N(); F() }\nfunc F() {}\n"),
    (3, "a.java", "package p;\nimport p.b;\nclass a extends b implements q.I { void m() { n(); } void n() { b.n(); } }\n"),
    (3, "b.java", "package p;\ninterface I {}\nclass b { void n() { } }\n"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "file_id int, repo_id int, file_path string, content string")


def test_as_of_plain_tables(spark):
    files = frame(spark, FILES)
    names = ("symbols", "imports", "calls", "inheritance")
    plain, parts = tables(extract(files)), tables(linked(files))
    order = ["repo_id", "src", "dst", "edge_type", "line_number"]
    expected = link.build(files, *(plain[n] for n in names)).select(order).collect()
    found = link.build_extracted(files, *(parts[n] for n in (*names, "contained"))).select(order).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, expected))
    assert {"CONTAINS", "IMPORTS", "CALLS", "EXTENDS", "IMPLEMENTS"} == {r.edge_type for r in found}


def shuffled(spark):
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), jvm.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_imports_are_not_shuffled_once_a_spelling(spark, tmp_path):
    n = 60
    rows = [(1, f"src/m{i}.py", f"from m{(i + 1) % n} import f\nclass C{i}:\n    def f(self): len(self)\n") for i in range(n)]
    frame(spark, rows).write.parquet(str(tmp_path / "parsed_files.parquet"))
    before = shuffled(spark)
    edges = io.extracted_graph(spark, str(tmp_path)).collect()
    assert len([r for r in edges if r.edge_type == "IMPORTS"]) >= n
    assert shuffled(spark) - before < 100 * n  # every import was tried as 192 paths, all of them shuffled
