"""Sums whose sign decides don't hang on the order of their terms."""

import itertools
import math
import random

from pyspark.sql import functions as F

from eventide.functions import scalar as S
from eventide.operators import measure as E


def test_wallet_day_that_cancels_is_a_gain_or_none_in_any_order(spark):
    orders = list(itertools.permutations([0.4, 0.3, -0.7]))  # sums to 0.0 or 5.6e-17 by its order, exactly to 5.6e-17
    rows = spark.createDataFrame([(w, 1, x) for w, order in enumerate(orders) for x in order], "wallet int, day int, x double").coalesce(1)
    got = E.wallets(rows, "wallet", "day", F.col("x"), 1).select("fills", "days", "pnl", "pos").distinct().collect()
    assert [tuple(r) for r in got] == [(3, 1, math.fsum([0.4, 0.3, -0.7]), 1.0)]


def test_exact_sum_is_the_rounded_sum(spark):
    random.seed(7)
    groups = [[random.choice([-1, 1]) * random.random() * 10 ** random.randint(-3, 6) for _ in range(50)] for _ in range(40)]
    groups += [[x, -x, 2.0**-50] for x in (1.2766, 24.958399999999997)] + [[1e300, -1e300], [2.0**40, 0.1]]
    rows = spark.createDataFrame([(g, x) for g, xs in enumerate(groups) for x in xs], "g int, x double").repartition(4)
    got = dict(map(tuple, rows.groupBy("g").agg(S.exact_sum("x").alias("s")).collect()))
    assert got == {g: math.fsum(xs) for g, xs in enumerate(groups)}


def test_exact_sum_of_nulls_and_infinities(spark):
    rows = spark.createDataFrame([(1, None), (2, 1.5), (2, None), (3, math.inf), (3, 1.0), (4, math.nan), (4, 1.0)], "g int, x double")
    got = dict(map(tuple, rows.groupBy("g").agg(S.exact_sum("x").alias("s")).collect()))
    assert got[1] is None and got[2] == 1.5 and got[3] == math.inf and math.isnan(got[4])
