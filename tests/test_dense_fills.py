"""Fills and extremes over dense prints, where nodes are asked instead of pairs: against plain Python, and how work grows."""

import random

import pytest
from pyspark.sql import functions as F

from eventide.operators import dyadic as D
from eventide.operators import fills as X


def world(seed, n_prints, n_orders):
    rng = random.Random(seed)
    prints = [(rng.choice([1, 1, 1, 2, None]), rng.randint(0, 3000), i, float(rng.randint(1, 40)), rng.randint(1, 9)) for i in range(n_prints)]
    orders = [(1000 + i, rng.choice([1, 1, 2, None, 3]), rng.randint(-50, 3050), rng.choice(["buy", "sell"]), float(rng.randint(1, 40)), rng.choice([1, 20, 300, 10_000])) for i in range(n_orders)]
    return prints, orders


def plain_fill(order, prints, life, strict):
    _, k, t, side, limit, qty = order
    done, at = 0, None
    for pk, pt, _, px, size in sorted(prints, key=lambda x: (x[1], x[2])):
        if pk == k and k is not None and t < pt <= t + life and ((px < limit if side == "buy" else px > limit) or (not strict and px == limit)):
            done += size
            if at is None and done >= qty:
                at = pt
    return min(done, qty), at


@pytest.mark.parametrize("few,top,step", [(10**6, 16, 6), (0, 16, 6), (0, 5, 2)])
@pytest.mark.parametrize("strict", [True, False])
def test_level_fills(spark, monkeypatch, few, top, step, strict):
    monkeypatch.setattr(D, "TOP", top)
    monkeypatch.setattr(D, "STEP", step)
    monkeypatch.setattr(D, "nodes_of", lambda a, b, top=top, of=D.nodes_of: of(a, b, top))
    prints, orders = world(1, 700, 150)
    p = spark.createDataFrame(prints, "k int, t long, event_id long, price double, size long")
    o = spark.createDataFrame(orders, "order_id long, k int, t long, side string, limit double, qty long")
    got = {r.order_id: (r.filled, r.done_at) for r in X.level_fills(o, p.where("k IS NOT NULL"), ["k"], "t", "order_id", 900, strict, few=few).collect()}
    assert got == {x[0]: plain_fill(x, prints, 900, strict) for x in orders}
    touched = {r.order_id: r.tau for r in X.first_touch(o, p.where("k IS NOT NULL"), ["k"], "t", "order_id", F.col("limit"), 900, few=few).collect()}
    for i, k, t, _, limit, _ in orders:
        later = [x[1] - t for x in prints if x[0] == k and k is not None and t < x[1] <= t + 900 and x[3] > limit]
        assert touched[i] == (min(later) if later else None)


@pytest.mark.parametrize("few", [0, 10**6])
def test_extremes(spark, few):
    prints, orders = world(2, 900, 120)
    p = spark.createDataFrame(prints, "k int, t long, event_id long, price double, size long").where("k IS NOT NULL")
    o = spark.createDataFrame(orders, "order_id long, k int, t long, side string, limit double, qty long")
    got = {r.order_id: (r.low, r.high) for r in D.extremes(o, p, ["k"], "t", "price", -20, 700, "order_id", few).collect()}
    want = {}
    for i, k, t, *_ in orders:
        px = [x[3] for x in prints if x[0] == k and k is not None and t - 20 <= x[1] <= t + 700]
        if px:
            want[i] = (min(px), max(px))
    assert got == want


def test_nodes_cover_a_stretch_once(spark):
    for top in (1, 3, 16):
        rows = spark.createDataFrame([(a, b) for a in range(0, 40, 3) for b in range(a, 60, 7)], "a long, b long").select("a", "b", D.nodes_of("a", "b", top).alias("n")).collect()
        for r in rows:
            places = sorted(p for n in r.n for p in range(n.node << n.k, (n.node + 1) << n.k))
            assert places == list(range(r.a, r.b))
            assert sum(n.k < top for n in r.n) <= 2 * top


def asked(spark, n):
    """Nodes that orders ask when n of them stand among n prints of one key, each alive for half of the time."""
    prints = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 10).alias("t"), F.col("id").alias("event_id"), (F.col("id") * 7 % 101).cast("double").alias("price"), F.lit(1).cast("long").alias("size"))
    orders = prints.select(F.col("event_id").alias("order_id"), "k", "t")
    placed = D.in_places(prints, ["k"], "t", ["event_id"])
    return D.stretches(orders, placed, ["k"], "t", 1, 5 * n).agg(F.sum(F.size(D.nodes_of("__first", "__last")))).first()[0]


def test_work_grows_with_rows(spark):
    """Pairs would grow by 16 from size to size; nodes asked grow by little more than 4."""
    sizes = [asked(spark, n) for n in (500, 2000, 8000)]
    assert all(b / a < 6 for a, b in zip(sizes, sizes[1:])) and sizes[-1] < 8000 * 2 * D.TOP
    few = spark.range(2000).select(F.lit(1).alias("k"), (F.col("id") * 10).alias("t"), F.col("id").alias("i"))
    assert not D.pairs_are_few(few, few, ["k"], "t", 1, 10_000) and D.pairs_are_few(few, few, ["k"], "t", 1, 100)
