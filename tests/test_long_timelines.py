"""As-of joins and interval look-ups at sizes where a key or a table has to be cut: against plain Python, and how rows spread."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from eventide.operators import asof as A


def timeline(seed, n, hot):
    """(key, t, id): key 0 has a third of the rows, in bursts; some keys are null."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = 0 if hot and rng.random() < 0.34 else rng.choice([None, *range(1, 60)])
        t = int(rng.choice([rng.gauss(10_000, 5), rng.uniform(-5e5, 5e5)]))
        out.append((k, t, i))
    return out


def plain_asof(probes, quotes, forward, strict, keyed):
    of = {}
    for k, t, i in quotes:
        of.setdefault(k if keyed else 0, []).append((t, i))
    out = {}
    for k, t, i in probes:
        line = sorted(of.get(k if keyed else 0, []))
        times = [x[0] for x in line]
        if forward:
            at = bisect.bisect_left(times, t)
            at = at if at < len(times) else None
        else:
            at = (bisect.bisect_left if strict else bisect.bisect_right)(times, t) - 1
        out[i] = line[at] if at is not None and at >= 0 else (None, None)
    return out


@pytest.mark.parametrize("by", [["k"], []])
@pytest.mark.parametrize("forward,strict", [(False, False), (False, True), (True, False)])
@pytest.mark.parametrize("most", [50, 10**9])
def test_asof_over_cells(spark, by, forward, strict, most):
    probes, quotes = timeline(1, 1500, True), timeline(2, 1500, True)
    p, q = (spark.createDataFrame(x, "k int, t long, id int") for x in (probes, quotes))
    how = {"direction": "forward" if forward else "backward", "allow_exact": not strict, "tie": ["id"], "most_rows": most}
    got = {r.id: (r.quote_t, r.q_id) for r in A.asof(p, q, by, "t", ["id"], prefix="q_", **how).collect()}
    assert got == plain_asof(probes, quotes, forward, strict, bool(by))


def test_hot_key_spreads(spark):
    """A key with a third of all rows is cut: no (key, cell), so no task's group, has more rows than the bound and a slot."""
    rows = spark.createDataFrame(timeline(3, 6000, True), "k int, __t long, id int")
    cut = A.in_cells(rows, ["k"], 200)
    sizes = cut.groupBy("k", "__cell").count().collect()
    assert max(r["count"] for r in sizes) <= 200 + max(r["count"] for r in rows.groupBy("k", "__t").count().collect())
    assert len({r["__cell"] for r in sizes if r.k == 0}) > 8
    assert all(r["__cell"] == 0 for r in sizes if r.k != 0)
    assert cut.count() == 6000
    ordered = cut.groupBy("k", "__cell").agg(F.min("__t").alias("lo"), F.max("__t").alias("hi")).where("k = 0").orderBy("__cell").collect()
    assert all(a.hi < b.lo for a, b in zip(ordered, ordered[1:]))


def test_feed_without_key_gathers_a_row_per_cell(spark):
    cut = A.in_cells(spark.createDataFrame(timeline(4, 6000, False), "k int, __t long, id int"), [], 300)
    sizes = [r["count"] for r in cut.groupBy("__cell").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 1000


def plain_lookup(values, bands):
    return sorted((i, w) for i, v in values for w in ([b for lo, hi, b in bands if v is not None and (lo is None or v >= lo) and (hi is None or v < hi)] or [None]))


@pytest.mark.parametrize("kind", ["double", "int", "date", "timestamp"])
def test_interval_index(spark, kind):
    rng = random.Random(kind)
    cast = lambda c: F.date_add(F.lit("2024-01-01"), F.col(c)) if kind == "date" else F.timestamp_micros(F.col(c).cast("long") * F.lit(1_000_000_007)) if kind == "timestamp" else F.col(c).cast(kind)
    point = (lambda: rng.uniform(-50, 450)) if kind == "double" else lambda: rng.randint(-50, 450)
    bands = []
    for b in range(150):
        lo, width = point(), rng.choice([0, 1, 3, 40, 400])
        bands.append((rng.choice([None, *[lo] * 30]), rng.choice([None, *[lo + width] * 30]), b))
    values = [(i, rng.choice([None, *[point() for _ in range(20)]])) for i in range(700)]
    number = "double" if kind == "double" else "int"
    df = spark.createDataFrame(values, f"id int, v {number}").select("id", cast("v").alias("v"))
    table = spark.createDataFrame(bands, f"lo {number}, hi {number}, b int").select(cast("lo").alias("lo"), cast("hi").alias("hi"), "b")
    for most in (10, 1000):
        got = A.range_lookup(df, table, "v", "lo", "hi", ["b"], most).collect()
        assert sorted(((r.id, r.b) for r in got), key=lambda x: (x[0], x[1] is None, x[1] or 0)) == sorted(plain_lookup(values, bands), key=lambda x: (x[0], x[1] is None, x[1] or 0))
    assert A.range_lookup(df.limit(0), table, "v", "lo", "hi", ["b"], 10).count() == 0


def test_interval_index_of_many(spark):
    """Many intervals and many points, a third of them on one value, without a nested loop."""
    n = 100_000
    bands = spark.range(n).select((F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 7).alias("hi"), F.col("id").alias("b"))
    points = spark.range(n).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") * 10 + F.col("id") % 10).alias("v"))
    out = A.range_lookup(points, bands, "v", "lo", "hi", ["b"])
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    counts = out.agg(F.count(F.lit(1)).alias("n"), F.count("b").alias("met"), F.count_if(F.col("b") != F.floor(F.col("v") / 10)).alias("wrong")).first()
    assert counts.n == n and counts.wrong == 0
    assert counts.met == sum(i % 3 == 0 or i % 10 < 7 for i in range(n))
