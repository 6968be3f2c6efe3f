"""Hand-computed cases of the kernel operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from eventide.functions import scalar as S
from eventide.operators import accounts as A
from eventide.operators import fills as X
from eventide.operators import grid as G
from eventide.operators import learn as L
from eventide.operators import market as M
from eventide.operators import measure as E
from eventide.operators import series
from eventide.operators.asof import asof, interval_join
from eventide.sources import tape as IO

QUOTES = [("a", 10, 1.0), ("a", 20, 2.0), ("a", 30, None), ("b", 15, 9.0), (None, 5, 7.0)]
PROBES = [(1, "a", 10), (2, "a", 25), (3, "a", 5), (4, "a", 35), (5, "b", 40), (6, None, 6), (7, "c", 10)]


def frames(spark):
    return spark.createDataFrame(PROBES, "id int, k string, t long"), spark.createDataFrame(QUOTES, "k string, t long, px double")


def written(df):
    from eventide.sources.tape import scratch

    path = scratch(df.sparkSession, "given")
    df.write.parquet(path)
    return path


def got(df, *cols):
    return {r[0]: tuple(r[1:]) if len(r) > 2 else r[1] for r in df.select("id", *cols).collect()}


@pytest.mark.parametrize("most", [1, 2, 1000])
def test_asof_backward(spark, most):
    p, q = frames(spark)
    out = got(asof(p, q, ["k"], "t", ["px"], most_rows=most), "quote_t", "px")
    # a matched quote with a null price stays matched; a null key meets a null key
    assert out == {1: (10, 1.0), 2: (20, 2.0), 3: (None, None), 4: (30, None), 5: (15, 9.0), 6: (5, 7.0), 7: (None, None)}


def test_asof_strict_forward_and_tolerance(spark):
    p, q = frames(spark)
    assert got(asof(p, q, ["k"], "t", ["px"], allow_exact=False), "px")[1] is None
    assert got(asof(p, q, ["k"], "t", ["px"], direction="forward"), "quote_t")[2] == 30
    assert got(asof(p, q, ["k"], "t", ["px"], tolerance_us=4), "quote_t") == {1: 10, 2: None, 3: None, 4: None, 5: None, 6: 5, 7: None}
    assert got(asof(p, q, ["k"], "t", ["px"], direction="forward", most_rows=1), "quote_t")[3] == 10


def test_asof_is_one_shuffle(spark):
    p, q = frames(spark)
    p, q = (spark.read.schema(x.schema).parquet(written(x)) for x in (p, q))
    plan = asof(p, q, ["k"], "t", ["px"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_asof_empty(spark):
    p, q = frames(spark)
    assert asof(p.limit(0), q, ["k"], "t", ["px"]).count() == 0
    assert got(asof(p, q.limit(0), ["k"], "t", ["px"]), "px") == dict.fromkeys(range(1, 8))


def test_interval_join_meets_each_pair_once(spark):
    p = spark.createDataFrame([(1, "a", 10)], "id int, k string, t long")
    r = spark.createDataFrame([("a", t, float(t)) for t in (9, 10, 14, 15, 16)], "k string, t long, px double")
    assert sorted(x.r_t for x in interval_join(p, r, ["k"], "t", 0, 5).collect()) == [10, 14, 15]


BOOK = [(7, 0.20, 50.0), (7, 0.25, 40.0), (7, 0.40, 100.0), (7, 0.00, 30.0), (7, 0.30, 0.0), (8, 0.75, 8.0), (9, 0.0, 5.0)]


def test_walk_ladder(spark):
    df = spark.createDataFrame(BOOK, "book int, price double, size double")
    rows = {(r.book, r.notional): r for r in X.walk_ladder(df, ["book"], "price", "size", ["price"], [5.0, 24.0, 60.0, 90.0]).collect()}
    # the levels cost 10, 10 and 40 in turn; those without a price or a size are skipped
    assert (rows[7, 5.0].avg_px, rows[7, 5.0].shares, rows[7, 5.0].exhausted) == (0.2, 25.0, False)
    assert rows[7, 24.0].shares == pytest.approx(50 + 40 + 4 / 0.4) and rows[7, 24.0].avg_px == pytest.approx(24 / 100)
    assert rows[7, 60.0].shares == pytest.approx(190) and not rows[7, 60.0].exhausted
    assert rows[7, 90.0].spent == pytest.approx(60) and rows[7, 90.0].exhausted
    assert rows[8, 24.0].spent == pytest.approx(6) and rows[8, 24.0].exhausted
    assert rows[9, 5.0].avg_px is None and rows[9, 5.0].spent == 0
    nested = df.groupBy("book").agg(F.sort_array(F.collect_list(F.struct("price", "size"))).alias("l"))
    walked = {r.book: (r.w.spent, r.w.shares) for r in nested.select("book", X.walk_array(F.col("l"), 24.0).alias("w")).collect()}
    assert walked[7] == pytest.approx((24, 100)) and walked[8] == pytest.approx((6, 8)) and walked[9] == (0, 0)


def test_walk_quantity(spark):
    df = spark.createDataFrame(BOOK, "book int, price double, size double")
    rows = {(r.book, r.quantity): (r.got, r.cost) for r in X.walk_quantity(df.where("price > 0"), ["book"], "price", "size", ["price"], (20.0, 95.0)).collect()}
    assert rows[7, 20.0] == pytest.approx((20, 4)) and rows[7, 95.0] == pytest.approx((95, 10 + 10 + 2)) and rows[8, 95.0] == pytest.approx((8, 6))


def test_level_fills(spark):
    prints = [(3, 0.62, 4), (7, 0.58, 6), (11, 0.60, 9), (15, 0.55, 5), (40, 0.50, 99)]
    tape = spark.createDataFrame([("m", t, p, s, i) for i, (t, p, s) in enumerate(prints)], "k string, t long, price double, size long, event_id int")
    rows = [
        (1, "m", 2, "buy", 0.60, 8),  # below 0.60: 6 at 7, then 2 of the 5 at 15
        (2, "m", 2, "buy", 0.60, 30),  # 11 of 30, the late print is out of its life
        (3, "m", 7, "buy", 0.70, 9),  # a print at its own time does not count
        (4, "m", 0, "sell", 0.57, 10),  # above 0.57: 4 at 3, 6 at 7
        (5, "z", 0, "sell", 0.57, 1),
    ]
    orders = spark.createDataFrame(rows, "id int, k string, t long, side string, limit double, qty long")
    out = {r.id: (r.filled, r.done_at) for r in X.level_fills(orders, tape, ["k"], "t", "id", 20).collect()}
    assert out == {1: (8, 15), 2: (11, None), 3: (9, 11), 4: (10, 7), 5: (0, None)}
    touching = {r.id: (r.filled, r.done_at) for r in X.level_fills(orders.where("id = 2"), tape, ["k"], "t", "id", 20, strict=False).collect()}
    assert touching == {2: (20, None)}


# The published price list of taker fees, in dollars for 100 shares at each price.
FEE_LIST = {
    0.01: 0.07, 0.05: 0.33, 0.10: 0.63, 0.15: 0.89, 0.20: 1.12, 0.25: 1.31, 0.30: 1.47, 0.35: 1.59, 0.40: 1.68, 0.45: 1.73, 0.50: 1.75,
    0.55: 1.73, 0.60: 1.68, 0.65: 1.59, 0.70: 1.47, 0.75: 1.31, 0.80: 1.12, 0.85: 0.89, 0.90: 0.63, 0.95: 0.33, 0.99: 0.07,
}


def test_fees(spark):
    df = spark.createDataFrame([(p,) for p in FEE_LIST], "p double")
    for r in df.select("p", S.taker_fee(F.lit(100), "p", F.lit(0.07)).alias("f")).collect():
        assert round(r.f + 1e-9, 2) == FEE_LIST[r.p]


def test_no_division_fails(spark):
    """Zero prices, constant series, one win and one loss, empty arms: null, never an error."""
    one = spark.range(1)
    wins = [(1, 1), (1, 0), (0, 0), (2, 1)]
    assert [one.select(S.runs_z(F.lit(2), F.lit(a), F.lit(b)).alias("z")).first().z is None for a, b in wins] == [True, True, True, False]
    z = lambda *a: one.select(S.two_proportion_z(*map(F.lit, a)).alias("z")).first().z
    assert z(0, 0, 1, 2) is None and z(1, 1, 2, 2) is None and z(1, 2, 2, 3) == pytest.approx(-0.1667 / 0.4472, abs=1e-3)
    assert one.select(S.payoff(F.lit(10.0), F.lit(0.0), F.lit(1), F.lit(0.01)).alias("p")).first().p is None
    assert [one.select(S.log_ratio(F.lit(a), F.lit(b)).alias("r")).first().r for a, b in ((0.0, 1.0), (1.0, 0.0), (-1.0, -1.0), (2.0, 2.0))] == [None, None, None, 0.0]
    flat = spark.createDataFrame([("a", t, 5.0) for t in range(6)] + [("b", t, float(t % 3)) for t in range(6)], "k string, t long, v double")
    by_key = E.autocorrelation(flat.withColumnRenamed("k", "key"), ["key"], ["t"], "v", [1]).collect()
    assert {x.key: x.r is None for x in by_key} == {"a": True, "b": False}
    two = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, True)], "k string, t long, up boolean")
    assert [(x.k, x.z) for x in E.runs_test(two, ["k"], ["t"], "up").collect()] == [("a", None)]
    feed = spark.createDataFrame([(t * 10, 0.0 if t < 3 else 1.0 + t) for t in range(12)], "t long, px double")
    probes = spark.createDataFrame([(1, 60), (2, 110), (3, 20)], "probe int, t long")
    signals = {x.probe: x for x in M.zsignal(probes, feed, "t", "px", 50, 40, 10, 0).collect()}
    assert signals[1].g is None and signals[2].g == pytest.approx(1e4 * math.log(12 / 7)) and signals[3].z is None
    assert L.auc(spark.createDataFrame([("a", 1.0, True), ("a", 2.0, True)], "k string, s double, y boolean"), ["k"], "s", "y").first().auc is None


def test_risk_path(spark):
    rows = [("a", 0, i, x) for i, x in enumerate((5.0, -4.0, -3.0, 1.0, None))] + [("a", 1, 9, -30.0), ("a", 2, 12, 90.0), ("b", 0, 1, -6.0), ("b", 0, 2, 8.0), ("b", 1, 3, 1.0)]
    df = spark.createDataFrame(rows, "k string, day int, t int, pnl double")
    out = {(r.k, r.t): r for r in A.risk_path(df, "k", "day", ["t"], "pnl", 30.0, 3, 6.0, recent=3, least=3, worst_t=-99.0).collect()}
    assert [(out["a", t].equity, out["a", t].drawdown, out["a", t].loss_run, out["a", t].status) for t in (0, 1, 2, 3, 4, 9, 12)] == [
        (5, 0, 0, "OK"), (1, 4, 1, "OK"), (-2, 7, 2, "OK"), (-1, 6, 0, "OK"), (-1, 6, 0, "OK"), (-31, 36, 1, "HALTED"), (59, 0, 0, "HALTED"),
    ]
    # the day's loss reached 6 with the first trade: the rest of that day is paused, the next is not
    assert [out["b", t].status for t in (1, 2, 3)] == ["PAUSED", "PAUSED", "OK"] and out["b", 1].drawdown == 6
    assert out["a", 1].decay_t is None and out["a", 2].decay_t == pytest.approx(-2 / 3 / (4.9329 / 3**0.5), abs=1e-4)
    halts = A.risk_path(df, "k", "day", ["t"], "pnl", 1e9, 99, 1e9, recent=3, least=3, worst_t=-0.2).where("status = 'HALTED'").agg(F.min("t").alias("t")).first()
    assert halts.t == 2
    assert A.risk_path(df.limit(0), "k", "day", ["t"], "pnl", 1.0, 1, 1.0).count() == 0


def test_scalars(spark):
    df = spark.createDataFrame([(0.0,), (1.96,), (-1.0,), (float("nan"),), (None,)], "z double")
    out = df.select(S.normal_cdf("z").alias("p"), S.finite("z").alias("f"), G.conjunction([("z", ">", 0.5)]).alias("c")).collect()
    assert out[0].p == pytest.approx(0.5, abs=1e-7) and out[1].p == pytest.approx(0.9750021, abs=1e-6) and out[2].p == pytest.approx(0.1586553, abs=1e-6)
    assert out[3].f is None and [r.c for r in out] == [False, True, False, False, False]


def test_streak_resets_on_gap(spark):
    df = spark.createDataFrame([("a", t, u) for t, u in ((1, True), (2, True), (3, False), (5, False), (6, False))], "k string, t long, up boolean")
    assert [(r.prior_up, r.streak) for r in series.with_streak(df, ["k"], "t", "up", 1).orderBy("t").collect()] == [(None, 0), (True, 1), (True, 2), (None, 0), (False, -1)]


def test_changes_only_and_gates(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, None), ("a", 4, None), ("a", 5, 2.0)], "k string, t long, v double")
    assert [r.t for r in series.changes_only(df, ["k"], ["t"], ["v"]).orderBy("t").collect()] == [1, 3, 5]
    gates = [("low", F.col("v") > 0), ("high", F.col("v") < 2)]
    assert [r[0] for r in df.orderBy("t").select(M.first_failing(gates)).collect()] == ["pass", "pass", "low", "low", "high"]


def test_sealed_days_and_incremental(spark, tmp_path):
    with pytest.raises(PermissionError):
        IO.assert_unsealed(10, 20, [5, 15])
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id int, date int")
    path = f"file://{tmp_path}/t"
    IO.build_missing(df.where("date = 1"), path, "date")
    IO.build_missing(df, path, "date")
    assert spark.read.parquet(path).count() == 3
    assert IO.with_schema(df, "id int, note string", {"note": "x"}).first().note == "x"


def model_rows(spark, label):
    rnd = random.Random(3)
    rows = []
    for i in range(1200):
        a, b = rnd.uniform(-1, 1), rnd.uniform(-1, 1)
        rows.append((i, i // 100, a, b, None if i % 50 == 0 else rnd.random(), float(label(a, b, rnd))))
    return spark.createDataFrame(rows, "event_id long, day long, x1 double, x2 double, x3 double, y double")


def measured(scored):
    rows = [(r.p, r.y) for r in scored.collect()]
    up, down = [p for p, y in rows if y], [p for p, y in rows if not y]
    auc = sum((p > q) + (p == q) / 2 for p in up for q in down) / (len(up) * len(down))
    loss = -sum(math.log(max(1e-9, p if y else 1 - p)) for p, y in rows) / len(rows)
    rate = len(up) / len(rows)
    return auc, loss, -rate * math.log(rate) - (1 - rate) * math.log(1 - rate)


def test_walk_forward_models(spark):
    """Out of fold, the linear model beats the base rate where the truth is linear, the trees also where it is not."""
    features = ["x1", "x2", "x3"]
    linear = model_rows(spark, lambda a, b, rnd: a + b + rnd.gauss(0, 0.3) > 0)
    scored = L.walk_forward(linear, features, "y", "day", 4, 1, L.logistic)
    auc, loss, base = measured(scored)
    assert auc > 0.95 and loss < 0.5 * base
    # each fold after the first, from models that saw neither it nor the day before it
    assert sorted({r.fold for r in scored.select("fold").distinct().collect()}) == [1, 2, 3] and scored.count() == 900
    crossed = model_rows(spark, lambda a, b, rnd: (a > 0) != (b > 0))
    trees = measured(L.walk_forward(crossed, features, "y", "day", 3, 1, L.boosted))
    straight = measured(L.walk_forward(crossed, features, "y", "day", 3, 1, L.logistic))
    assert trees[0] > 0.95 and trees[1] < 0.5 * trees[2] and straight[0] < 0.65
    assert L.walk_forward(linear.withColumn("y", F.lit(1.0)), features, "y", "day", 3, 1, L.logistic).count() == 0


def test_isotonic_steps(spark):
    df = spark.createDataFrame([(0.1, 0.0), (0.2, 1.0), (0.3, 0.0), (0.4, 0.0), (0.5, 1.0), (0.6, 1.0)], "p double, y double")
    out = {r.p: r.calibrated for r in L.isotonic(df, "p", "y").collect()}
    assert [out[p] for p in (0.1, 0.2, 0.3, 0.4, 0.5, 0.6)] == pytest.approx([0, 1 / 3, 1 / 3, 1 / 3, 1, 1])
    assert L.isotonic(df.limit(0), "p", "y").count() == 0


def test_max_drawdown(spark):
    rnd = random.Random(5)
    rows = [(k, d, t, rnd.uniform(-3, 3)) for k in "ab" for d in range(6) for t in range(rnd.randint(1, 9))]
    df = spark.createDataFrame(rows, "k string, d int, t int, x double")
    for k, fall in ((r.k, r.max_drawdown) for r in G.max_drawdown(df, ["k"], "d", ["d", "t"], "x").collect()):
        cum, peak, most = 0.0, -1e9, 0.0
        for _, _, _, x in sorted(r for r in rows if r[0] == k):
            cum += x
            peak = max(peak, cum)
            most = max(most, peak - cum)
        assert fall == pytest.approx(most)


def test_walk_of_the_other_side(spark):
    bids = spark.createDataFrame([(1, 0.6, 10.0), (1, 0.7, 5.0), (1, 0.2, 100.0), (1, 1.0, 9.0)], "k int, px double, size double")
    out = X.walk_ladder(bids, ["k"], "px", "size", ["px"], [1.5, 3.5], limit=F.lit(0.5), complement=True).orderBy("notional").collect()
    # the other side stands at 0.3 for 5 and at 0.4 for 10; at 0.8 it is beyond the limit, and a price of 0 is none
    assert [r.shares for r in out] == pytest.approx([5.0, 10.0]) and [r.avg_px for r in out] == pytest.approx([0.3, 0.35])


@pytest.mark.parametrize("bucket", [None, 1, 7, 1000])
def test_interval_join_buckets(spark, bucket):
    p = spark.createDataFrame([(i, i * 13 % 50) for i in range(20)], "id int, t long")
    q = spark.createDataFrame([(i, i * 7 % 60) for i in range(30)], "n int, t long")
    got_ = sorted((r.id, r.r_n) for r in interval_join(p, q, [], "t", -3, 6, bucket_us=bucket).collect())
    assert got_ == sorted((i, j) for i in range(20) for j in range(30) if -3 <= j * 7 % 60 - i * 13 % 50 <= 6)


def test_lead_lag_over_blocks(spark):
    rnd = random.Random(2)
    walk = [rnd.uniform(1, 9) for _ in range(300)]
    a = spark.createDataFrame([(10 * i, p) for i, p in enumerate(walk) if i % 17], "t long, px double")
    b = spark.createDataFrame([(10 * i + 30, p) for i, p in enumerate(walk)], "t long, px double")
    wide = {r.lag: (r.n, r.r) for r in E.lead_lag(a, b, "t", "px", 10, 5, block=100_000).collect()}
    cut = {r.lag: (r.n, r.r) for r in E.lead_lag(a, b, "t", "px", 10, 5, min_n=10, block=7).collect()}
    assert set(cut) == set(range(-5, 6)) and max(cut, key=lambda k: cut[k][1]) == 3
    assert all(cut[k][0] == wide[k][0] and cut[k][1] == pytest.approx(wide[k][1], abs=1e-9) for k in cut)
