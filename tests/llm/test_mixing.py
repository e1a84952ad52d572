import pytest

from strandline.llm import mixing as m

SIZED = "doc_id bigint, source string, n_tokens bigint"
TARGETS = "source string, target_share double, max_repeats int, wanted int"


def make(spark, targets, total=None, sizes=None):
    rows = [(i, "big", 10 + i % 7) for i in range(400)] + [(1000 + i, "small", 5) for i in range(10)] + [(2000, None, 5), (2001, "none", 7), (2002, "big", 0)]
    sized = spark.createDataFrame(rows if sizes is None else sizes, SIZED)
    planned = m.plan(sized, spark.createDataFrame(targets, TARGETS), total)
    mixed = m.mix(sized, planned)
    return mixed, {r.source: r for r in m.shares(mixed, planned).collect()}


def test_shares_and_repeats(spark):
    mixed, got = make(spark, [(" BIG ", 0.8, 1, 1), ("small", 0.15, 3, 1), ("absent", 0.05, 4, 1)], 1000)
    assert got["big"].given == pytest.approx(800, abs=10)
    assert got["small"].given == 150 and got["small"].most_copies == 3 and got["small"].target_can_be_met
    assert got["absent"].given == 0 and not got["absent"].target_can_be_met
    assert got[None].given == 0 and got["none"].given == 0
    uses = {}
    for r in mixed.collect():
        uses.setdefault(r.doc_id, []).append(r.copy)
    assert max(len(x) for k, x in uses.items() if k < 1000) == 1
    assert all(len(x) == 3 and len(set(x)) == 3 for k, x in uses.items() if 1000 <= k < 2000)


def test_a_target_that_cannot_be_met(spark):
    _, got = make(spark, [("big", 0.5, 1, 1), ("small", 0.5, 2, 1)], 1000)
    assert got["small"].given == 100 and not got["small"].target_can_be_met
    assert got["big"].given == pytest.approx(500, abs=10)
    assert got["big"].actual_share + got["small"].actual_share == pytest.approx(1)


def test_order_follows_the_schedule(spark):
    mixed, _ = make(spark, [("big", 0.7, 2, 1), ("small", 0.3, 40, 1)], 2000)
    rows = mixed.collect()
    assert [r.time for r in rows] == sorted(r.time for r in rows) and 0 <= rows[0].time and rows[-1].time <= 1
    half = [sum(r.n_tokens for r in rows if r.source == "small" and lo <= r.time < hi) for lo, hi in ((0, 0.5), (0.5, 1.1))]
    assert half[1] > half[0] > 0  # the smaller source's weight rises


def test_integral_and_inverse(spark):
    q = spark.range(0, 101).selectExpr("id / 100.0D as q", "0.4D as a", "-0.3D as b", "0.0D as z")
    for t in ("a", "b", "z"):
        from pyspark.sql import functions as F

        for r in q.select("q", F.col(t).alias("t"), m._time(F.col("q"), F.col(t)).alias("x")).collect():
            assert (1 + r.t) * r.x - r.t * r.x * r.x == pytest.approx(r.q, abs=1e-9)


def test_empty(spark):
    mixed, got = make(spark, [("big", 1.0, 1, 1)], sizes=[])
    assert mixed.count() == 0 and got["big"].given == 0
    mixed, _ = make(spark, [])
    assert mixed.count() == 0
    _, got = make(spark, [("big", None, None, 1), (None, 0.4, 2, 1)])
    assert got["big"].given == 0
