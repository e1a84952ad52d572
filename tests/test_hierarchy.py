import random

from strandline.operators import hierarchy as h

SCHEMA = "edge_type string, source_id string, target_id string, parent string, depth int"


def brute(parents):
    out = {}
    for n in parents:
        seen, cur = [n], parents[n]
        while cur in parents and cur not in seen:
            seen.append(cur)
            cur = parents[cur]
        if cur not in parents:
            out[n] = (cur, len(seen))
        else:
            out[n] = ("", -1 if cur == n or n in seen[seen.index(cur) :] else -2)
    return out


def test_forest_with_cycles(spark):
    r = random.Random(5)
    parents = {f"n{i}": f"n{r.randrange(max(0, i - 3), i)}" for i in range(1, 120)}
    parents |= {"c0": "c1", "c1": "c2", "c2": "c0", "t0": "c1", "t1": "t0", "t2": "t1", "s": "s", "u": "s"}
    data = [("contains ", p, n, None, 1) for n, p in parents.items()] + [("EXTENDS", n, p, "x", 2) for n, p in parents.items()]
    data += [("CONTAINS", "n0", "n1", None, 1), ("CONTAINS", None, "n5", None, 1), ("CONTAINS", "n5", None, None, 1), (None, "a", "b", None, 1), ("CALLS", "a", "b", None, 1)]
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    got = {(x.edge_type, x.node_id): (x.root_id, x.depth) for x in h.resolve(h.parent_links(df)).collect()}
    want = brute(parents)
    assert got == {(k, n): v for k in h.KINDS for n, v in want.items()}


def test_paths_and_descendants(spark):
    data = [("CONTAINS", "a", "b", None, 0), ("CONTAINS", "b", "c", None, 0), ("CONTAINS", "b", "d", None, 0), ("CONTAINS", "x", "x", None, 0)]
    found = h.resolve(h.parent_links(spark.createDataFrame(data, SCHEMA)), with_path=True)
    got = {x.node_id: x.path for x in found.collect()}
    assert got == {"b": ["a", "b"], "c": ["a", "b", "c"], "d": ["a", "b", "d"], "x": None}
    below = {(x.ancestor_id, x.node_id, x.distance) for x in h.descendants(found).collect()}
    assert below == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "d", 2), ("b", "d", 1)}


def test_empty(spark):
    assert h.resolve(h.parent_links(spark.createDataFrame([], SCHEMA))).count() == 0


def test_one_parent_with_most_children(spark):
    data = [("CONTAINS", "root", "hub", None, 0)] + [("CONTAINS", "hub", f"k{i}", None, 0) for i in range(3000)]
    found = h.resolve(h.parent_links(spark.createDataFrame(data, SCHEMA)))
    assert found.where("root_id = 'root' and depth = 2").count() == 3000
