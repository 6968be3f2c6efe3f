"""Tape, window and fee operators: outcomes, down-sampling, flow features, signals, fees, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .asof import asof, range_lookup
from .series import trailing_at


def downsample_last(df: DataFrame, by: Sequence[str], ts: str, grid_us: int, cols: Sequence[str], lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """The last row of each key and grid cell, optionally of rows in [lo, hi] only (the filter comes before the grouping)."""
    if lo is not None:
        df = df.where(F.col(ts).between(lo, hi))
    return df.groupBy(*by, F.floor(F.col(ts) / grid_us).alias("cell")).agg(F.max_by(F.struct(ts, *cols), ts).alias("__r")).select(*by, "cell", "__r.*")


def window_outcomes(feed: DataFrame, windows: DataFrame, ts: str, price: str, start: str, dur_us: int, max_lag_us: int, tie: str = "up", shift_us: int = 0) -> DataFrame:
    """windows with open, close and up: the first tick at or after each boundary, at most ``max_lag_us`` later.

    up is null where either is missing; equal prices are up (``tie='down'``: down).  ``shift_us`` moves the feed, for
    look-ahead controls.
    """
    ticks = feed.select((F.col(ts) + shift_us).alias("__at"), F.col(price).alias("__px"))
    how = dict(direction="forward", tolerance_us=max_lag_us, quote_ts="__when")
    # both boundaries go through one as-of: the feed is read for one timeline
    edges = F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col(start).alias("at")), F.struct(F.lit(False).alias("first"), (F.col(start) + dur_us).alias("at"))))
    near = asof(windows.withColumn("__e", edges).withColumn("__at", F.col("__e.at")), ticks, [], "__at", ["__px"], **how)
    priced = near.groupBy(*windows.columns).agg(F.max(F.when(F.col("__e.first"), F.col("__px"))).alias("open"), F.max(F.when(~F.col("__e.first"), F.col("__px"))).alias("close"), F.count_if("__e.first").alias("__rows"))
    both = priced.withColumn("__rows", F.explode(F.sequence(F.lit(1), "__rows"))).drop("__rows")  # repeated windows stay so
    return both.withColumn("up", F.col("close") >= F.col("open") if tie == "up" else F.col("close") > F.col("open"))


def flow_features(probes: DataFrame, prints: DataFrame, by: Sequence[str], ts: str, sign: Column, size: str, price: str, widths_us: dict[str, int], large: float) -> DataFrame:
    """Taker flow before each probe: imb_w = net / gross over (T - w, T], null without flow; net, prints and the imbalance
    of large prints over the same ranges; open_imb over everything so far."""
    rows = prints.withColumns({"__g": F.col(size).cast("double"), "__n": sign * F.col(size), "__bn": F.when(F.col(size) >= large, sign * F.col(size)), "__bg": F.when(F.col(size) >= large, F.col(size).cast("double"))}).select(*by, ts, "__g", "__n", "__bn", "__bg")
    aggregates = {}
    for name, width in [*widths_us.items(), ("open", None)]:
        aggregates |= {f"__net_{name}": (F.sum("__n"), width), f"__gross_{name}": (F.sum("__g"), width)}
        if width:
            aggregates |= {f"prints_{name}": (F.count("__g"), width), f"__bn_{name}": (F.sum("__bn"), width), f"__bg_{name}": (F.sum("__bg"), width)}
    out = trailing_at(probes, rows, by, ts, aggregates)
    for name in [*widths_us, "open"]:
        out = out.withColumn(f"imb_{name}", F.when(F.col(f"__gross_{name}") > 0, F.col(f"__net_{name}") / F.col(f"__gross_{name}")))
        if name != "open":
            out = out.withColumn(f"net_{name}", F.coalesce(f"__net_{name}", F.lit(0))).withColumn(f"big_imb_{name}", F.when(F.col(f"__bg_{name}") > 0, F.col(f"__bn_{name}") / F.col(f"__bg_{name}")))
    return out.drop(*(c for c in out.columns if c.startswith("__")))


def tape_features(probes: DataFrame, prints: DataFrame, by: Sequence[str], ts: str, tie: Sequence[str], sign: Column, size: str, price: str, width_us: int) -> DataFrame:
    """probes with what the prints in (T - width, T] say: ofi (net over gross size), intensity (prints a second), vwap_dev (the
    last price over the size-weighted mean, less 1) and rvol (root of the sum of squared log returns from print to print).

    Null without prints; a print without a positive price counts in ofi and intensity only, and returns skip it.
    """
    w = Window.partitionBy(*by).orderBy(ts, *tie)
    good = F.when(F.col(price) > 0, F.col(price).cast("double"))
    rows = prints.select(*by, ts, *tie, F.col(size).cast("double").alias("__s"), (sign * F.col(size)).cast("double").alias("__n"), good.alias("__p"))
    last = F.last("__p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__r2", F.pow(S.log_ratio("__p", last), F.lit(2.0))).withColumn("__v", F.col("__p") * F.col("__s")).withColumn("__ps", F.when(F.col("__p").isNotNull(), F.col("__s")))
    at = F.when(F.col("__p").isNotNull(), F.struct(ts, *tie))
    rows = rows.withColumn("__at", at)
    sums = {f"__{k}": (F.sum(f"__{c}"), width_us) for k, c in (("net", "n"), ("gross", "s"), ("r2s", "r2"), ("vs", "v"), ("pss", "ps"))}
    out = trailing_at(probes, rows.drop(*tie), by, ts, sums | {"__c": (F.count("__s"), width_us), "__last": (F.max_by("__p", "__at"), width_us)})
    return out.withColumns(
        {
            "ofi": S.ratio("__net", "__gross"),
            "intensity": F.when(F.col("__c") > 0, F.col("__c") / (width_us / 1e6)),
            "vwap_dev": S.ratio("__last", S.ratio("__vs", "__pss")) - 1,
            "rvol": F.sqrt("__r2s"),
        }
    ).drop(*sums, "__c", "__last")


def with_fee(trades: DataFrame, regimes: DataFrame, shares: str, price: str, date: str, exponent: float = 1.0) -> DataFrame:
    """trades with rate and fee (taker; a maker pays none) of the regime that the date falls into; those of no regime, as without
    a date, are left out."""
    rated = range_lookup(trades, regimes, date, "lo", "hi", ["rate"]).where("rate IS NOT NULL")
    return rated.withColumn("fee", S.taker_fee(shares, price, "rate", exponent))


def infer_regimes(fills: DataFrame, date: str, implied: Column, min_paid: int, min_all: int, min_days: int) -> DataFrame:
    """(lo, hi, rate): runs of days with one implied fee rate; hi is the next run's start, null at the end.

    A day's rate is the median implied rate of its paying fills, to three decimals, 0 with fewer than ``min_paid`` of
    them or where not more than half of the fills pay; a day with fewer than ``min_all`` fills says nothing.  A run that
    spans fewer than ``min_days`` days joins the run before it.  The windows below run over one row per day.
    """
    daily = fills.withColumn("__i", implied).groupBy(F.col(date).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__i") > 0).alias("paid"), F.median(F.when(F.col("__i") > 0, F.col("__i"))).alias("m")).where(F.col("n") >= min_all)
    rated = daily.select("day", F.when((F.col("paid") >= min_paid) & (F.col("paid") / F.col("n") > 0.5), S.rounded("m", 3)).otherwise(0.0).alias("rate"))
    w = Window.orderBy("day")
    runs = rated.withColumn("new", (~F.col("rate").eqNullSafe(F.lag("rate").over(w))).cast("int")).withColumn("run", F.sum("new").over(w)).groupBy("run").agg(F.min("day").alias("lo"), F.max("day").alias("last"), F.first("rate").alias("rate"))
    r = Window.orderBy("run")
    steady = runs.where((F.datediff("last", "lo") + 1 >= min_days) | (F.col("run") == 1))
    merged = steady.withColumn("same", F.col("rate").eqNullSafe(F.lag("rate").over(r))).where(~F.col("same"))
    return merged.select("lo", F.lead("lo").over(r).alias("hi"), "rate")


def coverage(rows: DataFrame, day: Column, expected: int) -> DataFrame:
    """(day, n, state) of every calendar day between the first and the last: full, partial or missing."""
    counts = rows.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    calendar = counts.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    joined = calendar.join(counts, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.withColumn("state", F.when(F.col("n") == 0, "missing").when(F.col("n") < expected, "partial").otherwise("full"))


def zsignal(probes: DataFrame, feed: DataFrame, ts: str, price: str, lookback_us: int, sigma_window_us: int, step_us: int, lat_us: int, ddof: int = 0, prices: dict[str, int] | None = None) -> DataFrame:
    """probes with g (log return over the look-back, in basis points), sigma of the same step's returns on a grid over the
    window before, and z = g / sigma; null where a price is missing or not positive, or sigma is 0.  ``prices`` names further
    columns, the feed's price as of the probe's time plus that offset.

    A price that is missing or not positive takes out the two returns of the grid that it is part of.  ``ddof`` 1 takes the
    sample's deviation in place of the population's.  Each row of probes stands for itself by all its columns."""
    ticks = feed.select(F.col(ts).alias("__at"), F.col(price).alias("__px"))
    # all that is asked of the feed goes through one as-of, each offset once: the grid has places from 0, what lies off it others
    place = {k * step_us - sigma_window_us - lat_us: k for k in range(sigma_window_us // step_us + 1)}
    for offset in (-lat_us, -lat_us - lookback_us, *(prices or {}).values()):
        place.setdefault(offset, -len(place))
    asks = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(offset).cast("long").alias("offset")) for offset, i in place.items()))
    asked = probes.withColumn("__g", F.explode(asks)).withColumn("__at", F.col(ts) + F.col("__g.offset")).withColumn("__i", F.col("__g.i")).drop("__g")
    seen = asof(asked, ticks, [], "__at", ["__px"], quote_ts="__q")
    along = Window.partitionBy(*probes.columns).orderBy("__i")
    step = F.when(F.col("__i") > 0, F.ln(F.col("__px")) - F.ln(F.lag("__px").over(along)))
    at = lambda offset: F.max(F.when(F.col("__i") == place[offset], F.col("__px")))
    more = {name: at(offset) for name, offset in (prices or {}).items()}
    signal = seen.withColumn("__r", step).groupBy(*probes.columns).agg(at(-lat_us).alias("__now"), at(-lat_us - lookback_us).alias("__then"), ((F.stddev_samp if ddof else F.stddev_pop)("__r") * 1e4).alias("sigma"), *(c.alias(name) for name, c in more.items()))
    signal = signal.select(*probes.columns, (1e4 * S.log_ratio("__now", "__then")).alias("g"), "sigma", *more)
    return signal.withColumn("z", F.when(F.col("sigma") > 0, F.col("g") / F.col("sigma")))


def irregular_sigma(probes: DataFrame, ticks: DataFrame, by: Sequence[str], ts: str, price: str, width_us: int, least: int) -> DataFrame:
    """probes with sigma: the population deviation of return / sqrt(seconds) over ticks in (T - width, T], null with fewer
    than ``least`` of them; the two returns around a price that is not positive are left out."""
    w = Window.partitionBy(*by).orderBy(ts)
    dt = (F.col(ts) - F.lag(ts).over(w)) / 1e6
    rows = ticks.withColumn("__r", F.when(dt > 0, (F.ln(price) - F.ln(F.lag(price).over(w))) / F.sqrt(dt))).select(*by, ts, "__r")
    out = trailing_at(probes, rows, by, ts, {"__sd": (F.stddev_pop("__r"), width_us), "__c": (F.count("__r"), width_us)})
    return out.withColumn("sigma", F.when(F.col("__c") >= least, F.col("__sd"))).drop("__sd", "__c")


def first_failing(gates: Sequence[tuple[str, Column]], passed: str = "pass") -> Column:
    """The name of the first gate that does not hold (null does not hold)."""
    out = None
    for name, test in gates:
        failed = ~F.coalesce(test, F.lit(False))
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out.otherwise(passed)


def reasons(gates: Sequence[tuple[str, Column]]) -> Column:
    """The names of all gates that do not hold."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in gates)))


def crossed_quotes(quotes: DataFrame, by: Sequence[str], ts: str, bid: str, ask: str, life_us: int) -> DataFrame:
    """Quotes with bid above ask that stood for ``life_us`` or longer until the next quote of their key."""
    w = Window.partitionBy(*by).orderBy(ts)
    return quotes.withColumn("life", F.lead(ts).over(w) - F.col(ts)).where((F.col(bid) > F.col(ask)) & (F.col("life") >= life_us))
