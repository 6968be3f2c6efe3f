"""z-signals and what is asked beside them go through one as-of; cells of a long timeline hold few rows."""

import pytest
from pyspark.sql import functions as F

from eventide.operators import asof as A
from eventide.operators import market as M
from eventide.plans import q_measure as Q


def test_response_curve_reads_the_feed_for_one_timeline(spark, sf, monkeypatch):
    calls = []
    counted = lambda *a, **how: calls.append(a) or A.asof(*a, **how)
    for module in (M, Q):
        monkeypatch.setattr(module, "asof", counted)
    Q.m16_response_curve(spark, sf)
    assert len(calls) == 1


def test_prices_beside_a_signal(spark):
    feed = spark.createDataFrame([(t * 10, None if t == 8 else 1.0 + t) for t in range(12)], "t long, px double")
    probes = spark.createDataFrame([(1, 60), (2, 75), (3, 20), (4, -5)], "probe int, t long")
    # offsets on the grid, off it, and like an end of the look-back
    offsets = {"same": 0, "ahead": 25, "back": -50, "odd": -3, "late": 500}
    signals = {r.probe: r for r in M.zsignal(probes, feed, "t", "px", 50, 40, 10, 0, prices=offsets).collect()}
    at = lambda t: None if t < 0 else None if min(t // 10, 11) == 8 else 1.0 + min(t // 10, 11)
    for probe, t in ((1, 60), (2, 75), (3, 20), (4, -5)):
        assert {n: signals[probe][n] for n in offsets} == {n: at(t + o) for n, o in offsets.items()}
    plain = {r.probe: (r.g, r.sigma, r.z) for r in M.zsignal(probes, feed, "t", "px", 50, 40, 10, 0).collect()}
    assert plain == {p: (r.g, r.sigma, r.z) for p, r in signals.items()} and plain[1][2] is not None


@pytest.mark.parametrize("by", [["k"], []])
def test_cells_of_a_long_timeline_are_small(spark, monkeypatch, by):
    """A cell's rows follow CELL_ROWS, not the bound of a key that stays whole."""
    monkeypatch.setattr(A, "CELL_ROWS", 100)
    rows = spark.range(6000).select(F.lit(0).alias("k"), F.col("id").alias("__t"), F.col("id").alias("id"))
    sizes = [r["count"] for r in A.in_cells(rows, by, 4000).groupBy("__cell").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 500
