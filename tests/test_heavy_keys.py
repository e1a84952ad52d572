import random

from strandline.operators import heavy_keys as k

SCHEMA = "key_id string, seq bigint, other string, n int"


def test_against_counting(spark):
    r = random.Random(2)
    data = [(r.choice(["hot"] * 6 + [f"k{i}" for i in range(40)] + [None]), i, r.choice(["a", "b", "c", None]), 1) for i in range(5000)]
    df = spark.createDataFrame(data, SCHEMA).repartition(9)
    for secondary, place in (("seq", 1), ("other", 2)):
        got = {x.key_id: (x.n, x.n_distinct) for x in k.per_key(df, "key_id", secondary, 6).collect()}
        want = {}
        for row in data:
            if row[0] is not None:
                want.setdefault(row[0], []).append(row[place])
        assert got == {key: (len(v), len(set(v))) for key, v in want.items()}


def test_heavy_counts_rows_with_null_keys(spark):
    data = [("a", 1, "", 1)] * 2 + [(None, 2, "", 1)] * 8
    df = spark.createDataFrame(data, SCHEMA)
    assert [x.key_id for x in k.heavy(df, "key_id", "seq", 0.2).collect()] == ["a"]
    assert k.heavy(df, "key_id", "seq", 0.21).count() == 0
    assert k.heavy(df.where("false"), "key_id", "seq").count() == 0


def test_ties_and_repeats(spark):
    df = spark.createDataFrame([("a", 1, "x", 1)] * 500, SCHEMA).repartition(5)
    assert [tuple(x) for x in k.per_key(df, "key_id", "seq", 4).collect()] == [("a", 500, 1)]


def test_one_pair_in_many_partitions(spark):
    rows = [("hot", "a" if i % 3 else "b", i) for i in range(3000)] + [(f"k{i % 7}", None if i % 2 else "x", i) for i in range(70)] + [(None, "a", 1)] * 5
    df = spark.createDataFrame(rows, "k string, s string, i int").repartition(5)
    for parts in (1, 4, 16):
        got = {r.key_id: (r.n, r.n_distinct) for r in k.per_key(df, "k", "s", parts, "i").collect()}
        assert got == {"hot": (3000, 2), **{f"k{i}": (10, 2) for i in range(7)}}
    sizes = df.where("k = 'hot'").repartitionByRange(8, "k", "s", "i").rdd.glom().map(len).collect()
    assert max(sizes) < 1500
