"""Measurement: calibration, runs, autocorrelation, lead-lag, ledgers, wallets, thresholds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .asof import asof
from .ranks import exact_quantiles, join_by, with_rank
from .series import with_islands


def calibration(decisions: DataFrame, prob: str, outcome: str, by: Sequence[str], breaks: Sequence[float], labels: Sequence[str], least: int) -> DataFrame:
    """Per cell of ``by`` and probability band: implied and realised rate, their gap and its standard error; cells with
    fewer than ``least`` rows are left out."""
    won = F.avg(F.col(outcome).cast("int"))
    cells = decisions.groupBy(*by, S.cut(prob, breaks, labels).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("implied"), won.alias("realised")).where(F.col("n") >= least)
    p = F.col("realised")
    return cells.withColumns({"gap": p - F.col("implied"), "se": F.sqrt(p * (1 - p) / F.col("n"))})


def runs_test(df: DataFrame, by: Sequence[str], order: Sequence[str], flag: str) -> DataFrame:
    """runs and their z per key; keys with one kind of outcome only have no test."""
    counted = with_islands(df, by, order, flag).groupBy(*by).agg(F.max("island").alias("runs"), F.count_if(flag).alias("n1"), F.count_if(~F.col(flag)).alias("n0"))
    return counted.where("n1 > 0 AND n0 > 0").withColumn("z", S.runs_z("runs", "n1", "n0"))


def autocorrelation(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, lags: Sequence[int], stretch: int = 100_000, ranges: int | None = None) -> DataFrame:
    """(by…, k, r) with the mean and the sum of squares of the whole series; r is null for a constant series.

    A series is cut into stretches of ``stretch`` places (more than the longest lag).  Each stretch also gets the last rows of
    the one before it, as many as the longest lag, so every lagged pair meets in one stretch and no task holds a series."""
    longest = max(lags)
    length = max(stretch, longest)
    means = df.groupBy(*by).agg(F.avg(value).alias("__m"))
    x = join_by(df.select(*by, *order, value), means, by).withColumn("__x", F.col(value) - F.col("__m"))
    placed = with_rank(x.drop("__m", value), by, order, "__i", ranges=ranges).withColumn("__i", F.col("__i") - 1)
    own = F.floor(F.col("__i") / length)
    into = F.when((F.col("__i") + longest) >= (own + 1) * length, F.array(own, own + 1)).otherwise(F.array(own))
    spread = placed.withColumn("__own", own).withColumn("__cut", F.explode(into))
    w = Window.partitionBy(*by, "__cut").orderBy("__i")
    lagged = spread.select(*by, "__x", "__own", "__cut", *(F.lag("__x", k).over(w).alias(f"__l{k}") for k in lags)).where("__own = __cut")
    sums = lagged.groupBy(*by).agg(F.sum(F.col("__x") * F.col("__x")).alias("__d"), *(F.sum(F.col("__x") * F.col(f"__l{k}")).alias(f"__s{k}") for k in lags))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), S.ratio(f"__s{k}", "__d").alias("r")) for k in lags)))
    return sums.select(*by, rows.alias("__r")).select(*by, "__r.*")


def lead_lag(a: DataFrame, b: DataFrame, ts: str, price: str, step_us: int, max_lag: int, min_n: int = 0, block: int = 4096) -> DataFrame:
    """(lag, n, r): correlation of a's grid returns with b's, ``lag`` steps later; at a positive best lag a leads.  r is null
    with fewer than ``min_n`` pairs.

    The grid is cut into blocks of steps, with the steps that lags reach into on both sides.  A block gives its sums for every
    lag, so what is shuffled is the grid once, and a row per block and lag."""
    span = a.select(ts).unionByName(b.select(ts)).agg(F.floor(F.min(ts) / step_us).alias("lo"), F.floor(F.max(ts) / step_us).alias("hi")).first()  # two numbers
    grid = a.sparkSession.range(span.lo or 0, (span.hi if span.hi is not None else -1) + 1).select(F.col("id").alias("step"), (F.col("id") * step_us).alias(ts))
    first = asof(grid, a.select(ts, price), [], ts, [price], prefix="__a_").drop("quote_t")
    both = asof(first, b.select(ts, price), [], ts, [price], prefix="__b_")
    size = max(block, max_lag + 1)
    near = F.array_distinct(F.array(*(F.floor((F.col("step") + d) / size) for d in (-max_lag, 0, max_lag + 1))))
    spread = both.select("step", F.ln(f"__a_{price}").alias("u"), F.ln(f"__b_{price}").alias("v"), F.explode(near).alias("block"))

    def sums(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        start = key[0] * size - max_lag - 1
        u, v = np.full((2, size + 2 * max_lag + 2), np.nan)
        at = part["step"].to_numpy() - start
        inside = (at >= 0) & (at < len(u))
        u[at[inside]], v[at[inside]] = part["u"].to_numpy(float)[inside], part["v"].to_numpy(float)[inside]
        dx, dy = (np.diff(c, prepend=np.nan) for c in (u, v))
        x, rows = dx[max_lag + 1 : max_lag + 1 + size], []
        for lag in range(-max_lag, max_lag + 1):
            y = dy[max_lag + 1 + lag : max_lag + 1 + lag + size]
            good = ~(np.isnan(x) | np.isnan(y))
            p, q = x[good], y[good]
            rows.append((lag, good.sum(), p.sum(), q.sum(), (p * p).sum(), (q * q).sum(), (p * q).sum()))
        return pd.DataFrame(rows, columns=["lag", "n", "x", "y", "xx", "yy", "xy"])

    each = spread.groupBy("block").applyInPandas(sums, "lag long, n long, x double, y double, xx double, yy double, xy double")
    total = each.groupBy("lag").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy"))).where("n > 0")
    n, (x, y, xx, yy, xy) = F.col("n"), map(F.col, ("x", "y", "xx", "yy", "xy"))
    r = S.ratio(n * xy - x * y, F.sqrt((n * xx - x * x) * (n * yy - y * y)))
    return total.select("lag", "n", F.when(n >= min_n, r).alias("r"))


def ledger(fills: DataFrame, token: str, side: str, price: str, amount: str, pay: Column) -> DataFrame:
    """fills with p_up (price of the Up side), dir (+1: the taker is long Up) and gross, the taker's result before fees."""
    up = F.col(token) == "Up"
    out = fills.withColumn("p_up", F.when(up, F.col(price)).otherwise(1 - F.col(price))).withColumn("dir", F.when((F.col(side) == "buy") == up, 1).otherwise(-1))
    return out.withColumn("gross", F.col("dir") * (pay - F.col("p_up")) * F.col(amount))


def wallets(rows: DataFrame, wallet: str, day: str, pnl: Column, min_days: int) -> DataFrame:
    """Per wallet: fills, days, pnl, daily Sharpe (population deviation), share of days with a gain; a day whose results are
    all missing is a day without one.

    Sums are exact: fills of a day that cancel are a gain or none whatever the order they are added in."""
    daily = rows.groupBy(wallet, day).agg(S.exact_sum(pnl).alias("__p"), F.count(F.lit(1)).alias("__n"))
    sd = F.stddev_pop("__p")
    return daily.groupBy(wallet).agg(
        F.sum("__n").alias("fills"), F.count(F.lit(1)).alias("days"), S.exact_sum("__p").alias("pnl"), F.when(sd > 0, F.avg("__p") / sd).alias("sharpe"), F.avg(F.when(F.col("__p") > 0, 1).otherwise(0)).alias("pos")
    ).where(F.col("days") >= min_days)


def train_thresholds(train: DataFrame, features: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """(feature, thr): the distinct rounded quantiles of each feature."""
    long = train.select(*(F.col(f).cast("double").alias(f) for f in features)).unpivot([], list(features), "feature", "x")
    return exact_quantiles(long, ["feature"], "x", quantiles).select("feature", S.rounded("v", 2).alias("thr")).distinct()
