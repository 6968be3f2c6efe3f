"""Fills against a tape: trade-through, touches, path extremes, walks of a ladder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import interval_join
from .dyadic import FEW, completions, pairs_are_few


def path_extremes(probes: DataFrame, prints: DataFrame, by: Sequence[str], ts: str, until: str, price: str) -> DataFrame:
    """probes with max_after and min_after: of prints with ``ts < print <= until``, where until never falls as ts rises
    within a window, so that a window's prints after a probe are those down to its end.

    Prints and probes of a key and window share one timeline, read backwards: a running maximum and minimum, no join.
    """
    width = F.col(until)
    line = probes.select(*by, ts, width.alias("__end"), F.struct(*probes.columns).alias("__probe"), F.lit(1).alias("__side"))
    ends = probes.select(*by, F.col(until).alias("__end")).distinct()
    # each print belongs to the first end at or after it
    from .asof import asof

    placed = asof(prints.select(*by, ts, price), ends.withColumn(ts, F.col("__end")), by, ts, ["__end"], direction="forward").drop("quote_t")
    both = line.unionByName(placed.where("__end IS NOT NULL").withColumn("__side", F.lit(0)), allowMissingColumns=True)
    # latest first; at equal times the probe comes first, since only later prints count
    w = Window.partitionBy(*by, "__end").orderBy(F.col(ts).desc(), F.col("__side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({"max_after": F.max(price).over(w), "min_after": F.min(price).over(w)})
    return out.where("__probe IS NOT NULL").select("__probe.*", "max_after", "min_after")


def level_fills(orders: DataFrame, prints: DataFrame, by: Sequence[str], ts: str, order_id: str, life_us: int, strict: bool = True, tie: str = "event_id", few: int = FEW) -> DataFrame:
    """orders (…, side, limit, qty) with filled and done_at: qualifying volume in ``(placed, placed + life]`` up to qty.

    A buy fills from prints below its limit, a sell from prints above (at it too if not strict); done_at is the time of the
    print that completes the quantity, null for a partial fill.  order_id names an order.  Where orders and prints are so dense
    that there would be more than ``few`` pairs for each of them, volumes by price level are asked instead.
    """
    if not pairs_are_few(orders, prints, by, ts, 1, life_us, few):
        done = completions(orders, prints, by, ts, order_id, tie, life_us, strict)
        return orders.join(done, order_id, "left").withColumn("filled", F.coalesce("filled", F.lit(0)))
    pairs = interval_join(orders, prints, by, ts, 1, life_us)
    low, high = F.col("r_price") < F.col("limit"), F.col("r_price") > F.col("limit")
    if not strict:
        low, high = F.col("r_price") <= F.col("limit"), F.col("r_price") >= F.col("limit")
    hit = pairs.where(F.when(F.col("side") == "buy", low).otherwise(high))
    w = Window.partitionBy(order_id).orderBy(f"r_{ts}", f"r_{tie}").rowsBetween(Window.unboundedPreceding, 0)
    run = hit.withColumn("__cum", F.sum("r_size").over(w))
    done = run.groupBy(order_id).agg(F.least(F.max("__cum"), F.first("qty")).alias("filled"), F.min(F.when(F.col("__cum") >= F.col("qty"), F.col(f"r_{ts}"))).alias("done_at"))
    return orders.join(done, order_id, "left").withColumn("filled", F.coalesce("filled", F.lit(0)))


def first_touch(probes: DataFrame, prints: DataFrame, by: Sequence[str], ts: str, probe_id: str, level: Column, life_us: int, tie: str = "event_id", few: int = FEW) -> DataFrame:
    """probes with tau: microseconds until the first later print above the level, null if there is none in time.

    It is the print that completes a sell of one unit at the level, if every print has one unit."""
    one = probes.select(probe_id, *by, ts, F.lit("sell").alias("side"), level.alias("limit"), F.lit(1).cast("long").alias("qty"))
    units = prints.select(*by, ts, tie, "price", F.lit(1).cast("long").alias("size"))
    done = level_fills(one, units, by, ts, probe_id, life_us, True, tie, few).select(F.col(probe_id).alias("__id"), F.col("done_at").alias("__done"))
    return probes.join(done, F.col(probe_id) == F.col("__id"), "left").withColumn("tau", F.col("__done") - F.col(ts)).drop("__id", "__done")


def walk_ladder(levels: DataFrame, by: Sequence[str], price: str, size: str, order: Sequence[str], notionals: Sequence[float], limit: Column | None = None, complement: bool = False) -> DataFrame:
    """A row per ladder and notional: avg_px, shares, spent and exhausted, taking levels in order until it is spent.

    Levels without a positive price and size are skipped, with ``limit`` also those beyond it.  exhausted: less than
    99.9 % could be spent; avg_px is null where nothing could.  ``complement`` buys the other side: a level's price is what is
    missing to 1, so the levels that were the dearest come first (``limit`` and avg_px are prices of the side that is bought).
    """
    if complement:
        levels = levels.withColumn(price, 1 - F.col(price))
    good = (F.col(price) > 0) & (F.col(size) > 0)
    if limit is not None:
        good = good & (F.col(price) <= limit)
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    usable = levels.withColumn("__cost", F.when(good, F.col(price) * F.col(size)).otherwise(0.0)).withColumn("__before", F.sum("__cost").over(w) - F.col("__cost"))
    asked = usable.withColumn("notional", F.explode(F.array(*map(F.lit, notionals))))
    take = F.least("__cost", F.greatest(F.col("notional") - F.col("__before"), F.lit(0.0)))
    spent = asked.withColumn("__take", take).groupBy(*by, "notional").agg(F.sum("__take").alias("spent"), F.sum(F.when(F.col("__take") > 0, F.col("__take") / F.col(price)).otherwise(0.0)).alias("shares"))
    return spent.select(*by, "notional", F.when(F.col("shares") > 0, F.col("spent") / F.col("shares")).alias("avg_px"), "shares", "spent", (F.col("spent") < 0.999 * F.col("notional")).alias("exhausted"))


def walk_quantity(levels: DataFrame, by: Sequence[str], price: str, size: str, order: Sequence[str], quantities: Sequence[float]) -> DataFrame:
    """Per ladder and quantity: got and cost of taking so many units, in one pass over the levels."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    asked = levels.withColumn("__before", F.sum(size).over(w) - F.col(size)).withColumn("quantity", F.explode(F.array(*map(F.lit, quantities))))
    take = F.least(F.col(size), F.greatest(F.col("quantity") - F.col("__before"), F.lit(0.0)))
    return asked.withColumn("__take", take).groupBy(*by, "quantity").agg(F.sum("__take").alias("got"), F.sum(F.col("__take") * F.col(price)).alias("cost"))


def walk_array(levels: Column, notional: float) -> Column:
    """The same walk over array<struct<price,size>> within a row: struct(spent, shares); levels without a positive price and
    size are skipped here too."""
    start = F.struct(F.lit(0.0).alias("spent"), F.lit(0.0).alias("shares"))

    def step(acc, level):
        good = (level["price"] > 0) & (level["size"] > 0)
        take = F.when(good, F.least(level["price"] * level["size"], F.lit(float(notional)) - acc["spent"])).otherwise(0.0)
        return F.struct((acc["spent"] + take).alias("spent"), (acc["shares"] + F.when(good, take / level["price"]).otherwise(0.0)).alias("shares"))

    return F.aggregate(levels, start, step)
