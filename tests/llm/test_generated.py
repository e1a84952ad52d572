import base64
import random

import numpy as np

from strandline.llm import generated as g
from strandline.llm.repair import re_pair

FILES = "file_id bigint, repo_id int, file_path string, content string, marks int"
CONFIG = "repo_id int, ignored_dirs array<string>"
SYMBOLS = "repo_id int, file_path string, complexity int"
UPSTREAM = "upstream_id int, file_path string, content string"
HAND = """class Store:
    def load(self, path):
        with open(path) as f:
            rows = f.read().split(';')
        return [r for r in rows if r]

    def save(self, path, rows):
        if not rows:
            raise ValueError('nothing to save')
        text = ';'.join(sorted(rows))
        with open(path, 'w') as f:
            f.write(text)

    def merge(self, other):
        for key, value in other.items():
            self.rows.setdefault(key, []).append(value)
        return len(self.rows)
"""
ACCESSORS = "".join(f"def get_{a}_{i}(msg):\n    return msg._values[{i}]\n\n" for i, a in enumerate("red green blue white black brown pink grey gold teal cyan plum".split()))
TABLE = "def step(state, token):\n" + "".join(f"    if state == {i} and token == {i * 7 % 31}:\n        return {i * 3 % 17}\n" for i in range(40)) + "    return -1\n"
DATA = "ROWS = [\n" + "".join("    " + ", ".join(str(random.Random(i).randrange(100)) for i in range(k, k + 9)) + ",\n" for k in range(0, 900, 9)) + "]\n"
MIXED = DATA[:300] + "]\n" + HAND
MINIFIED = "var a=[1,2];" + "".join(f"function f{i}(t){{return t&&t.x{i * 7}||{{}}}}!function(q){{q.y=function(){{for(var i=0;i<{i};i++)this.z^=i<<2}}}}({{}});" for i in range(6))
PROSE = "# Notes\n\n" + "This folder holds the code of the store, and it is not complete yet in any way that would matter to those who read it for the first time.\n" * 3


def reason(text, path="src/a.py"):
    return g.features([text], [path.endswith(".py")])[0][0]


def test_texts():
    assert reason(HAND) is None
    assert reason("") is None
    assert reason(ACCESSORS) == "generated"
    assert reason(TABLE) is None and g.features([TABLE], [True])[0][1] > 0.75
    assert reason(DATA) == "data"
    assert reason(MIXED) is None
    blob = base64.b64encode(random.Random(1).randbytes(1500)).decode()
    assert reason('{"a": [1, 2], "b": {"c": "' + blob + '"}}', "a.ts") == "data"
    assert reason(f'def blob():\n    return "{blob}"\n') == "data"
    assert reason("SEAL = '" + random.Random(2).randbytes(1500).hex() + "'\n") == "data"
    assert reason(MINIFIED, "a.js") == "minified"
    assert reason(PROSE) is None
    assert reason("SEAL = '" + "Ab3+" * 200 + "'\n" + HAND) is None


def test_what_hands_write():
    getters = "class Account {\n" + "".join(f"  public String get{x}() {{\n    return this.{x.lower()};\n  }}\n" for x in "Name Mail Phone Street City".split()) + "}\n"
    tests = "".join(f"def test_{x}():\n    r = run('{x}')\n    assert r.ok\n\n" for x in "alpha beta gamma delta eps zeta".split())
    colours = "COLOURS = {\n" + "".join(f"    'colour{chr(97 + i)}': '#{i * 9999:06x}',\n" for i in range(25)) + "}\n"
    words = "permission is granted to use copy modify and distribute this work for any purpose provided that the notice above stays in all copies and that no name of its makers is used to promote what was made of it".split()
    licence = " ".join(random.Random(3).choice(words) for _ in range(900))
    assert [reason(x, "a.java") for x in (getters, tests, colours, f'LICENCE = """{licence}"""\n')] == [None] * 4


def test_headers():
    for header in ("# Code generated by tool. DO NOT EDIT.", "# @generated by x", "# This file was automatically generated by tool 2; changes will be lost.", "# <auto-generated> tool </auto-generated>", "# AUTO-GENERATED FILE - made from the schema", "# Created by the x tool on each build. Do not modify by hand.", "# Generated from grammar file by x 2"):
        assert reason(f"{header}\n{HAND}") == "generated", header
        assert reason(f"{HAND}\n{header}\n") == "generated", header
        assert reason(f"{header.replace('#', '//')}\nexport const a = 1;\n", "a.js") == "generated", header
        assert reason(f"X = '''\n{header}\n'''\n{HAND}") is None, header
    for mention in ("# Writes the generated stubs (the ones marked DO NOT EDIT) for each schema.", "# The ids are generated by the allocator; do not edit a row once it is stored.", "# Vendor invoices only: third party carriers are handled elsewhere."):
        assert reason(f"{mention}\n{HAND}") is None, mention


def test_grammars_give_the_sequences_back():
    r = random.Random(1)
    for least in (2, 3, 5):
        rows = [[r.randrange(4) for _ in range(r.randrange(60))] for _ in range(40)]
        made = re_pair(np.array([x for row in rows for x in row]), np.repeat(np.arange(len(rows)), [len(x) for x in rows]), least)

        def expand(x):
            return [int(made.word[x])] if x < made.terminals else expand(made.pairs[x - made.terminals][0]) + expand(made.pairs[x - made.terminals][1])

        uses, length = made.uses(), made.upwards(np.ones(made.terminals, np.int64), np.add)
        for i, row in enumerate(rows):
            left = [x for x in made.left if made.group[x] == i]
            assert [y for x in left for y in expand(x)] == row
            pairs = [tuple(p) for p in zip(left, left[1:])]
            assert all(pairs.count(p) < least or p[0] == p[1] for p in pairs)
            assert all(len(expand(x)) == length[x] and uses[x] >= (least if x >= made.terminals else 0) for x in range(len(uses)) if made.group[x] == i)


def test_files(spark):
    other = HAND.replace("Store", "Shop").replace("rows", "items")
    copy = "# own header\n\n" + HAND.replace("    def merge", "\n    # changed\n    def merge")
    rows = [(1, 1, "src/a.py", HAND, 0), (2, 1, "src/b.py", copy, 0), (3, 1, "./x/gen/y/c.py", other, 0), (4, 2, "gen/c.py", other, 0), (5, 1, "gen.py", other, 0), (6, 1, "src/d.py", None, 0), (7, 3, "src/e.py", ACCESSORS, 0), (8, None, None, "y = 2\n", 0), (9, 3, "./src/t.py", TABLE[: len(TABLE) // 2] + HAND, 0), (10, 4, "src/t.py", TABLE[: len(TABLE) // 2] + HAND, 0)]
    files = spark.createDataFrame(rows + rows[1:3], FILES)
    config = spark.createDataFrame([(1, ["gen"]), (2, ["dist"])], CONFIG)
    upstream = spark.createDataFrame([(1, "lib/h.py", HAND), (2, "lib/t.py", ACCESSORS.replace("msg", "row"))], UPSTREAM)
    symbols = spark.createDataFrame([(3, "src/t.py", 90), (None, None, 99)], SYMBOLS)
    got = {r.file_id: r.reason for r in g.not_hand_written(files, config, upstream, symbols).collect()}
    assert got == {1: "third-party copy", 2: "third-party copy", 3: "ignored folder", 7: "generated", 9: "generated"}
    assert g.not_hand_written(files.where("false"), config, upstream, symbols).count() == 0
    assert {r.file_id for r in g.not_hand_written(files, config.where("false"), upstream.where("false"), symbols.where("false")).collect()} == {7}


def test_repeated_rows_count_once(spark):
    theirs = "".join(f"alpha_{i} = first({i})\n" for i in range(8))
    own = theirs + "".join(f"def beta_{c}(x):\n    return x.{c} + other_{c}\n" for c in "abcdef")
    part = "".join(theirs.splitlines(True)[:5]) + "omega = last()\n"
    files = spark.createDataFrame([(1, 1, "a.py", own, 0)] * 4 + [(2, 1, "b.py", part, 0)] * 5 + [(3, 1, "c.py", theirs, 0)] * 3 + [(4, 1, "d.py", own, 0), (4, 1, "d.py", "x = 1\n" + own, 0)], FILES)
    upstream = spark.createDataFrame([(1, "lib/t.py", theirs)], UPSTREAM)
    got = {r.file_id: r.reason for r in g.not_hand_written(files.repartition(3), spark.createDataFrame([], CONFIG), upstream, spark.createDataFrame([], SYMBOLS)).collect()}
    assert got.get(3) == "third-party copy"
    assert all(got.get(i) != "third-party copy" for i in (1, 2, 4)), got


def test_passages_of_several_repositories(spark):
    r = random.Random(4)
    differs = ["".join(f"v{r.randrange(10**6)} = f{r.randrange(10**6)}(w{r.randrange(10**6)})\n" for _ in range(40)) for _ in range(6)]
    own = differs.pop()
    rows = [(i, i, f"src/{i}.py", own + f"tail = {i}\n", 0) for i in range(3)] + [(10 + i, i, f"src/x{i}.py", x, 0) for i, x in enumerate(differs)] + [(20 + i, 7, f"src/y{i}.py", "# c\n" + differs[0].replace("v", "u"), 0) for i in range(4)]
    files = spark.createDataFrame(rows, FILES)
    nothing = [spark.createDataFrame([], x) for x in (CONFIG, UPSTREAM, SYMBOLS)]
    got = {r.file_id: r.reason for r in g.not_hand_written(files, *nothing).collect()}
    assert got == dict.fromkeys(range(3), "shared across repositories")  # four copies within one repository are its own
