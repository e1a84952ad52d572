import json
import os
import time

from strandline import cli
from strandline.operators import graph
from strandline.sources import config, export, scan
from strandline.streaming import watch


def tree(root):
    for path, text in {"app/core.py": "from app.util import help\n\ndef run():\n    help()\n", "app/util.py": "def help():\n    return 1\n\ndef unused():\n    return 2\n", "node_modules/x.py": "x = 1\n", ".hid/y.py": "y = 1\n", "app/notes.txt": "no\n", "big.js": "x" * 100}.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)


def test_scan_and_cache(spark, tmp_path):
    root = tree(tmp_path / "repo")
    got = {r.file_path: r.language for r in scan.scan(spark, root, max_bytes=90).collect()}
    assert got == {"app/core.py": "python", "app/util.py": "python"}
    cache = str(tmp_path / "cache")
    first = scan.extract_cached(spark, scan.scan(spark, root), cache)
    assert first.count() == 3
    (tmp_path / "repo/app/util.py").write_text("def other():\n    return 1\n")
    old, new = scan.split_by_cache(scan.scan(spark, root), scan.load_cache(spark, cache))
    assert (old.count(), [r.file_path for r in new.collect()]) == (2, ["app/util.py"])
    again = {s.id for r in scan.extract_cached(spark, scan.scan(spark, root), cache).collect() for s in r.symbols}
    assert "app/util.py::other" in again and "app/util.py::help" not in again and "app/core.py::run" in again
    assert scan.load_cache(spark, str(tmp_path / "none")) is None


def test_config(tmp_path):
    assert config.load(str(tmp_path)).max_file_size_bytes == scan.MAX_BYTES
    (tmp_path / "pyproject.toml").write_text('[tool.strandline]\nignored_dirs = ["x"]\n[tool.strandline.rules]\nmax_complexity = 7\nforbidden_imports = [{from = "a/*", to = "b/*"}]\nmax_instability = [{module = "m"}]\n')
    c = config.load(str(tmp_path))
    assert c.ignored_dirs == (*scan.IGNORED_DIRS, "x") and c.rules.max_complexity == 7 and c.rules.forbidden[0]["severity"] == "error" and c.rules.instability == [{"module": "m", "max_i": 0.5}]
    (tmp_path / "strandline.toml").write_text("max_file_size_bytes = 5\n[rules]\nmax_risk_gate = 50\n")
    c = config.load(str(tmp_path))
    assert c.max_file_size_bytes == 5 and c.rules.max_risk == 50.0 and c.ignored_dirs == scan.IGNORED_DIRS
    (tmp_path / "strandline.toml").write_text("= broken")
    assert config.load(str(tmp_path)).max_file_size_bytes == scan.MAX_BYTES


def test_cli(spark, tmp_path, capsys):
    root = tree(tmp_path / "repo")
    assert cli.main(["dead-code", "--dir", root], spark) == 0
    assert [json.loads(x)["name"] for x in capsys.readouterr().out.splitlines()] == ["run", "unused"]
    assert cli.main(["blast-radius", "help", "--dir", root], spark) == 0
    report = json.loads(capsys.readouterr().out.splitlines()[0])
    assert report["upstream_callers"][0].startswith("app/core.py::") and report["up"] == 2
    assert cli.main(["blast-radius", "nothing", "--dir", root], spark) == 1
    assert cli.main(["path", "run", "help", "--dir", root], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["edge_type"] == "CALLS"
    assert cli.main(["export", "mermaid", "--dir", root], spark) == 0 and "graph LR" in capsys.readouterr().out
    assert cli.main(["lint", "--dir", root], spark) == 0
    capsys.readouterr()
    assert cli.main(["scan", "--dir", root], spark) == 0
    totals = json.loads(capsys.readouterr().out)
    assert totals["dead_symbols_count"] == 2 and totals["cycles_count"] == 0
    (tmp_path / "repo/app/util.py").write_text("def help():\n    return 1\n")
    assert cli.main(["dead-code", "--dir", root, "--output", str(tmp_path / "dead.json")], spark) == 0
    assert [json.loads(x)["name"] for x in (tmp_path / "dead.json").read_text().splitlines()] == ["run"]
    for kind in ("json", "sarif", "html", "dot"):
        assert cli.main(["export", kind, "--dir", root, "--no-cache", "--output", str(tmp_path / kind)], spark) == 0
    assert json.loads((tmp_path / "sarif").read_text())["runs"][0]["results"][0]["ruleId"] == "RG002"
    assert len(json.loads((tmp_path / "json").read_text())["nodes"]) == 5
    assert 'id="elements"' in (tmp_path / "html").read_text()


def test_cli_diff(spark, tmp_path, capsys):
    import subprocess

    root = tree(tmp_path / "repo")
    git = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b.c", *a], cwd=root, check=True, capture_output=True)
    git("init")
    git("add", "app")
    git("commit", "-m", "a")
    (tmp_path / "repo/app/util.py").write_text("def help():\n    return 7\n\ndef unused():\n    return 2\n")
    assert cli.main(["diff", "--base", "HEAD", "--format", "json", "--dir", root], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["symbols"] == 1 and got["total_impacted"] == 3 and got["modified"][0]["qualified_name"] == "help"
    assert cli.main(["diff", "--base", "HEAD", "--format", "markdown", "--max-risk", "1", "--dir", root], spark) == 1
    assert "### Symbols modified" in capsys.readouterr().out


def test_cli_watch(spark, tmp_path, capsys):
    import threading

    root = tree(tmp_path / "repo")
    stop = threading.Event()

    def touch():
        n = 0
        while not stop.wait(3):
            n += 1
            (tmp_path / f"repo/app/more{n}.py").write_text("def more():\n    return 1\n")

    t = threading.Thread(target=touch)
    t.start()
    try:
        assert cli.main(["watch", "--polls", "1", "--dir", root], spark) == 0
    finally:
        stop.set()
        t.join()
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert lines[0]["op"] == "added" and lines[-1]["total_symbols"] >= 4


def test_exports(spark):
    symbols = spark.createDataFrame([("a.py::f", 1, "f", "f", "function", "a.py", 1, 2, None, True, False, 1), ("a.py::K", 2, 'K"q', "K", "class", "a.py", 3, 4, None, True, False, 1)], "id string, symbol_seq bigint, name string, qualified_name string, kind string, file_path string, line_start int, line_end int, docstring string, is_exported boolean, is_entrypoint boolean, complexity int")
    nodes = graph.vertices(symbols)
    edges = spark.createDataFrame([("a.py::f", "a.py::K", 1, "IMPORTS", 3, "a.py")], "src string, dst string, edge_pos bigint, edge_type string, line_number int, file_path string")
    lines = [r.line for r in export.dot_lines(nodes, edges).orderBy("place").collect()]
    assert lines[0].startswith("digraph") and lines[-1] == "}" and 'label="K\\"q\\n(class)", fillcolor=lightblue' in lines[2] and "style=dashed" in lines[3]
    assert sum(json.loads(r.json).get("source") == "a.py::f" for r in export.json_lines(nodes, edges).collect()) == 1
    assert json.loads(export.elements(nodes, edges).where("group = 'edges'").first().json)["data"]["id"] == "a.py::f->a.py::K"
    text = export.mermaid(nodes, edges)
    assert 'subgraph S1["a.py"]' in text and "N1 -->|IMPORTS| N2" in text
    found = export.sarif_results(spark.createDataFrame([(2, ["a", "b", "a"])], "length int, nodes array<string>"), nodes, spark.createDataFrame([("m", "a.py:7", "warning"), ("n", "a.py", "error")], "message string, source_location string, severity string"))
    lines = {(r.rule, r.level, json.loads(r.json)["locations"][0]["physicalLocation"]["region"]["startLine"]) for r in found.collect()}
    assert {("RG001", "error", 1), ("RG002", "warning", 3), ("RG003", "warning", 7), ("RG003", "error", 1)} <= lines
    whole = lambda df: json.loads("\n".join(r.line for r in df.orderBy("place").collect()))
    assert len(whole(export.sarif_document(found.unionByName(found)))["runs"][0]["results"]) == 2 * found.count()
    assert whole(export.sarif_document(found.where("false")))["runs"][0]["results"] == []
    both = whole(export.json_document(nodes, edges))
    assert [x["id"] for x in both["nodes"]] and both["edges"][0]["target"] == "a.py::K"
    entry = nodes.withColumn("is_entrypoint", nodes.is_exported)
    assert "fillcolor=salmon" in "".join(r.line for r in export.dot_lines(entry, edges).where("line like '%(class)%'").collect())


def test_watch(spark, tmp_path):
    root = tree(tmp_path / "repo")
    before = watch.snapshot(spark, root)
    later = time.time() + 5
    (tmp_path / "repo/app/new.py").write_text("x = 1\n")
    (tmp_path / "repo/app/util.py").write_text("x = 2\n")
    os.utime(tmp_path / "repo/app/util.py", (later, later))
    (tmp_path / "repo/app/core.py").unlink()
    got = {r.file_path: r.op for r in watch.differences(before, watch.snapshot(spark, root)).collect()}
    assert got == {"app/new.py": "added", "app/util.py": "changed", "app/core.py": "deleted"}
    seen = []
    query = watch.watch(spark, root, lambda changed, now: seen.append({r.file_path: r.op for r in changed.collect()}))
    (tmp_path / "repo/app/more.py").write_text("x = 1\n")
    for _ in range(60):
        if seen:
            break
        time.sleep(0.5)
    query.stop()
    assert seen and seen[0] == {"app/more.py": "added"}


def test_windows_on_a_stream(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = watch.windowed_counts(spark.read.parquet(src))
    spark.read.parquet(src).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = watch.windowed_counts(spark.readStream.schema(spark.read.parquet(src).schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("windows").exceptAll(batch).count() == 0 == batch.exceptAll(spark.table("windows")).count()
