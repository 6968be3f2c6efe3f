"""Ranks, quantiles and rule grids that no single task orders: against plain Python, and how far keys are spread."""

import math
import random
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import grid as G
from eventide.operators import measure as E
from eventide.operators import ranks as R


def plan(df):
    return df._jdf.queryExecution().toString()


def test_ranks_of_keys(spark):
    rng = random.Random(1)
    rows = [(None if k == 0 else k, rng.randint(0, 40), i) for i, k in enumerate(rng.choices([0, 1, 2, 3], [2, 10, 1, 1], k=3000))]
    df = spark.createDataFrame(rows, "k int, x int, id int")
    got = {r.id: (r.place, r.n) for r in R.with_rank(df, ["k"], [F.desc("x"), "id"], "place", "n", ranges=16).collect()}
    for k in (None, 1, 2, 3):
        ordered = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in ordered] == [(i + 1, len(ordered)) for i in range(len(ordered))]
    everything = {r.id: r.rank for r in R.with_rank(df, [], ["x", "id"]).collect()}
    assert [everything[r[2]] for r in sorted(rows, key=lambda r: r[1:])] == list(range(1, 3001))
    assert R.with_rank(df.limit(0), ["k"], ["x"]).count() == 0


def test_quantiles(spark):
    rng = random.Random(2)
    values = {"a": [rng.gauss(0, 1) for _ in range(5000)], "b": [float(rng.randint(0, 3)) for _ in range(4001)], "c": [7.5], None: [1.0, 2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in [*vs, None]], "k string, v double").repartition(5)
    qs = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    out = R.exact_quantiles(df, ["k"], "v", qs, ranges=12)
    got = {(r.k, r.q): r.v for r in out.collect()}
    assert len(got) == len(values) * len(qs)
    for (k, q), v in got.items():
        assert v == pytest.approx(np.quantile(values[k], q), abs=1e-12)
    assert {r.q: r.v for r in R.exact_quantiles(df.where("k = 'c'"), [], "v", [0.5]).collect()} == {0.5: 7.5}
    assert R.exact_quantiles(df.limit(0), ["k"], "v", qs).count() == 0
    assert "percentile" not in plan(out)
    wide = R.quantile_columns(df, ["k"], "v", {"lo": 0.1, "mid": 0.5, "same": 0.5}).where("k = 'b'").first()
    assert (wide.lo, wide.mid, wide.same) == (np.quantile(values["b"], 0.1), np.quantile(values["b"], 0.5), np.quantile(values["b"], 0.5))


def test_few_keys_spread_over_ranges(spark):
    """Three keys, one with most rows: no range, so no task, holds a key."""
    df = spark.range(120_000).select(F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 3).alias("k"), F.xxhash64("id").cast("double").alias("v"))
    ranged = R.in_ranges(df, ["k"], ["v"], 24)
    sizes = [r["count"] for r in ranged.groupBy("__range").count().collect()]
    keys = {r.k: r.n for r in ranged.groupBy("k").agg(F.countDistinct("__range").alias("n")).collect()}
    assert max(sizes) < 120_000 / 24 * 2 and keys[0] >= 15
    assert ranged.groupBy("k", "__range").count().groupBy("k", "__range").count().where("count > 1").isEmpty()


def test_autocorrelation_over_cuts(spark):
    rng = random.Random(3)
    series = {"a": [rng.random() for _ in range(500)], "b": [rng.random() for _ in range(3)], "c": [2.0] * 40}
    df = spark.createDataFrame([(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)], "k string, i int, v double")
    got = {}
    for r in E.autocorrelation(df.withColumnRenamed("k", "key"), ["key"], ["i"], "v", (1, 5, 20), stretch=21, ranges=9).collect():
        got[r.key, r.k] = r.r
    for name, x in series.items():
        m = statistics.fmean(x)
        d = sum((a - m) ** 2 for a in x)
        for k in (1, 5, 20):
            want = sum((x[i] - m) * (x[i - k] - m) for i in range(k, len(x))) / d if d else None
            if len(x) > k or want is None:
                assert got[name, k] is None if want is None else got[name, k] == pytest.approx(want, abs=1e-12)


def plain_scores(rows, configs, pay):
    ops = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
    out = {}
    for cid, feature, op, thr, side in configs:
        found = defaultdict(list)
        for r in rows:
            x = r[feature]
            if x is not None and not math.isnan(x) and ops[op](x, thr) and pay[side](r) is not None:
                found[r["split"]].append(pay[side](r))
        for s, p in found.items():
            n, total = len(p), sum(p)
            sd = statistics.stdev(p) if n > 1 else 0.0
            loss = -sum(x for x in p if x < 0)
            out[cid, s] = (n, total, total / n, total / n / (sd / math.sqrt(n)) if sd else 0.0, sum(x for x in p if x > 0) / loss if loss else None, sum(x > 0 for x in p) / n)
    return out


@pytest.mark.parametrize("most", [250_000, 30])
def test_rule_scores(spark, most):
    rng = random.Random(4)
    rows = [{"a": rng.choice([None, float("nan"), *map(float, range(8))]), "b": rng.random(), "p": rng.choice([None, 1.0, -1.0, 0.0, 2.5]), "split": rng.choice(["train", "val"])} for _ in range(900)]
    configs = [(f"{f}{op}{thr}{side}", f, op, thr, side) for f, ts in (("a", [0.0, 3.0, 3.5, 7.0, 9.0, -1.0]), ("b", [0.0, 0.25, 0.999, 2.0])) for thr in ts for op in (">", ">=", "<", "<=") for side in ("up", "down")]
    df = spark.createDataFrame([(r["a"], r["b"], r["p"], r["split"]) for r in rows], "a double, b double, p double, split string")
    rules = spark.createDataFrame(configs, "cid string, feature string, op string, thr double, side string")
    got = {(r.cid, r.split): tuple(r)[2:] for r in G.score_configs(df, rules, ["split"], {"up": F.col("p"), "down": -F.col("p") - 0.5}, most).collect()}
    want = plain_scores(rows, configs, {"up": lambda r: r["p"], "down": lambda r: None if r["p"] is None else -r["p"] - 0.5})
    assert set(got) == set(want)
    for k in want:
        assert all(x == y if x is None or y is None else x == pytest.approx(y, abs=1e-9) for x, y in zip(got[k], want[k])), k
    assert G.score_configs(df, rules.limit(0), ["split"], {"up": F.col("p")}).count() == 0
    assert G.score_configs(df.limit(0), rules, ["split"], {"up": F.col("p"), "down": F.col("p")}).count() == 0
    with pytest.raises(ValueError):
        G.score_configs(df, rules.withColumn("feature", F.lit("none")), ["split"], {"up": F.col("p")})


def test_many_rules_make_no_row_per_hit(spark):
    """100,000 rules over 20,000 decisions: what is joined and windowed grows with their sum."""
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("a"), (F.col("id") % 13 - 6).cast("double").alias("p"), F.lit("all").alias("split"))
    rules = spark.range(100_000).select(F.col("id").alias("cid"), F.lit("a").alias("feature"), F.when(F.col("id") % 2 == 0, ">").otherwise("<").alias("op"), (F.col("id") / 5).alias("thr"), F.lit("up").alias("side"))
    scored = G.score_configs(df, rules, ["split"], {"up": F.col("p")})
    assert "CartesianProduct" not in plan(scored) and "NestedLoop" not in plan(scored)
    rows = {r.cid: r for r in scored.where(F.col("cid").isin(0, 1, 40_000, 99_999)).collect()}
    held = [(i * 7919 % 20_011, i % 13 - 6) for i in range(20_000)]
    for cid, r in rows.items():
        hit = [p for a, p in held if (a > cid / 5 if cid % 2 == 0 else a < cid / 5)]
        assert (r.n, r.total) == (len(hit), sum(hit))
    assert 1 not in rows or rows[1].n == sum(a < 0.2 for a, _ in held)
    assert Counter(type(r.n) for r in rows.values()) == {int: len(rows)}
