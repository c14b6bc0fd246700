"""Global places, ranks and running folds against plain Python, with a hot group, ties, nulls and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from skarn.operators import metrics as M
from skarn.operators import ranks as R


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    groups = ["hot"] * 900 + ["a"] * 60 + [None] * 30 + ["one"]
    found = [(g, rng.choice([None, *range(12)]) if g != "a" else 7, i) for i, g in enumerate(groups)]
    rng.shuffle(found)
    return found


@pytest.fixture
def table(spark, rows):
    return spark.createDataFrame(rows, "g string, v int, id int").repartition(5)


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def null_first(x):
    return (x is not None, x)


def test_numbered(table, rows):
    want = {r[2]: i for g in grouped(rows).values() for i, r in enumerate(sorted(g, key=lambda r: (null_first(r[1]), r[2])), 1)}
    got = R.numbered(table, ["g"], R.ascending("v", "id"), "at")
    assert got.columns == ["g", "v", "id", "at"] and {r.id: r.at for r in got.collect()} == want


def test_a_hot_group_spans_many_tasks(spark, table):
    """No stage after the range exchange gives a task the hot group: its rows lie in several ranges."""
    spread = table.repartitionByRange(4, "g", "v", "id").filter("g = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread > 1
    plan = R.numbered(table, ["g"], R.ascending("v", "id"), "at")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_running(table, rows, block, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", block)
    sums, tops = {}, {}
    for g in grouped(rows).values():
        total, top = 0, None
        for r in sorted(g, key=lambda r: (null_first(r[1]), r[2])):
            total, top = total + (r[1] or 0), max(top or 0, r[1]) if r[1] is not None else top
            sums[r[2]], tops[r[2]] = total, top
    order = R.ascending("v", "id")
    assert {r.id: r.s for r in R.running(table, ["g"], order, F.col("v"), F.sum, "s").collect()} == sums
    assert {r.id: r.s for r in R.running(table, ["g"], order, F.col("v"), F.max, "s").collect()} == tops


def test_mean_ranks_and_lookups_that_are_joined(table, rows, monkeypatch):
    monkeypatch.setattr(R, "SMALL", 0)
    want = {}
    for g in grouped(rows).values():
        for r in g:
            less, same = sum(null_first(x[1]) < null_first(r[1]) for x in g), sum(x[1] == r[1] for x in g)
            want[r[2]] = less + (same + 1) / 2
    assert {r.id: r.k for r in R.mean_ranks(table, ["g"], "v", "k").collect()} == want


def test_order_statistics_and_holm(spark, table, rows):
    values = {g: sorted(r[1] for r in x if r[1] is not None) for g, x in grouped(rows).items()}
    got = {r.g: (r.p50, r.p95) for r in M.order_statistics(table, "v", {"p50": 0.5, "p95": 0.95}, ["g"]).collect()}
    assert got == {g: tuple(v[min(len(v) - 1, int(q * len(v)))] for q in (0.5, 0.95)) for g, v in values.items() if v}
    p = spark.createDataFrame([("x", i, (i * 7 % 10) / 100) for i in range(10)] + [("y", 1, 0.5)], "g string, id int, p double")
    adjusted = {(r.g, r.id): round(r.p_adjusted, 9) for r in M.holm(p, "p", ["g"]).collect()}
    best, want = 0.0, {("y", 1): 0.5}
    for k, (x, i) in enumerate(sorted((i * 7 % 10 / 100, i) for i in range(10))):
        best = max(best, min(1.0, (10 - k) * x))
        want["x", i] = round(best, 9)
    assert adjusted == want


@pytest.mark.parametrize("at_once", [1, 7, 1000])
def test_bootstrap_in_parts_draws_like_one_loop(spark, at_once):
    """Parts of any length give the draws of a plain loop, for groups of several sizes, one value and a null group."""
    rng = random.Random(9)
    rows = [(g, i, rng.random()) for g, n in (("a", 5), ("b", 37), (None, 5), ("one", 1)) for i in range(n)]
    values = spark.createDataFrame(rows, "g string, place int, v double").repartition(3)
    got = M.bootstrap_means(values, "g", 40, 2027, at_once).collect()
    assert spark.createDataFrame([(0,)], "x int").count() and len(got) == 4 * 41
    for g in ("a", "b", None, "one"):
        vs = [v for k, _, v in rows if k == g]
        draw = random.Random(2027)
        want = {-1: sum(vs) / len(vs)} | {d: sum(draw.choice(vs) for _ in vs) / len(vs) for d in range(40)}
        assert {r.draw: r["mean"] for r in got if r.g == g} == want
    low, high = sorted(want[d] for d in range(40))[1], want[0]
    ends = {r.g: (r.lo, r.hi) for r in M.interval(M.bootstrap_means(values, "g", 40, 2027, at_once), "g", 1, 39).collect()}
    assert ends["one"] == (low, high) and len(ends) == 4


def test_empty(spark, table):
    none = table.limit(0)
    assert R.numbered(none, ["g"], R.ascending("v"), "at").count() == 0
    assert R.mean_ranks(none, ["g"], "v", "k").count() == 0
    assert R.running(none, ["g"], R.ascending("v"), F.col("v"), F.sum, "s").count() == 0
