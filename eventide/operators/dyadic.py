"""Stretches of a key's rows in time as few dyadic nodes, so that a question about a stretch is asked of nodes, not rows.

Rows get their place within their key.  Node (k, node) holds the places from node * 2^k on, 2^k of them.  Any stretch of
places is the union of at most two nodes a level, and of whole nodes of the top level, which is low enough for a task to hold a
node of it.  What nodes know is computed once, over rows times levels, and a stretch joins its nodes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof, interval_join
from .ranks import join_by, kept, with_rank

#: The top level: a node of it holds 65,536 rows.  Levels that one step of a descent passes; rows that are then paired.
TOP, STEP = 16, 6
#: Up to so many pairs for each probe and row, pairs are made; beyond, nodes are asked.
FEW = 32


def nodes_of(first: str, last: str, top: int = TOP) -> Column:
    """array<struct<k, node>> of the places first <= p < last, both columns of long."""
    lo, hi = f"shiftright({first} + shiftleft(1L, k) - 1, k)", f"shiftright({last}, k)"
    node = lambda test, at: f"if({lo} < {hi} AND {test}, named_struct('k', k, 'node', {at}), NULL)"
    below = f"flatten(transform(sequence(0, {top - 1}), k -> filter(array({node(f'{lo} % 2 = 1', lo)}, {node(f'{hi} % 2 = 1', f'{hi} - 1')}), x -> x IS NOT NULL)))"
    a, b = f"shiftright({first} + {(1 << top) - 1}, {top})", f"shiftright({last}, {top})"
    return F.expr(f"concat({below}, if({a} < {b}, transform(sequence({a}, greatest({b} - 1, {a})), n -> named_struct('k', {top}, 'node', n)), CAST(array() AS array<struct<k: int, node: bigint>>)))")


def pairs_are_few(probes: DataFrame, rows: DataFrame, by: Sequence[str], ts: str, lo_us: int, hi_us: int, few: int = FEW) -> bool:
    """Whether interval_join would make no more than ``few`` candidates for each probe and row, by counts per time bucket."""
    bucket = max(1, hi_us - lo_us)
    at = lambda us: F.floor((F.col(ts) + us) / bucket)
    asked = probes.select(*by, F.explode(F.sequence(at(lo_us), at(hi_us))).alias("__b")).groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__p"))
    there = rows.groupBy(*by, at(0).alias("__b")).agg(F.count(F.lit(1)).alias("__r"))
    both = asked.join(there, [*by, "__b"], "full").agg(F.sum(F.col("__p") * F.col("__r")), F.sum("__p"), F.sum("__r")).first()
    return (both[0] or 0) <= few * ((both[1] or 0) + (both[2] or 0))


def in_places(rows: DataFrame, by: Sequence[str], ts: str, tie: Sequence[str]) -> DataFrame:
    """rows as a written table with __i, their place within their key by time, from 0."""
    ranked = with_rank(rows, by, [ts, *tie], "__i")
    return kept(ranked.withColumn("__i", F.col("__i") - 1), "places")


def stretches(probes: DataFrame, placed: DataFrame, by: Sequence[str], ts: str, lo_us: int, hi_us: int) -> DataFrame:
    """probes with __first and __last: places __first <= p < __last are the rows with ts + lo <= t <= ts + hi."""
    near = {"tie": ["__i"], "quote_ts": "__when"}
    before = asof(probes.withColumn("__now", F.col(ts)).withColumn(ts, F.col(ts) + lo_us), placed, by, ts, ["__i"], allow_exact=False, prefix="__a", **near).drop("__when")
    until = asof(before.withColumn(ts, F.col("__now") + hi_us), placed, by, ts, ["__i"], prefix="__b", **near).drop("__when").withColumn(ts, F.col("__now"))
    place = lambda c: F.coalesce(F.col(c) + 1, F.lit(0))
    return until.select(*probes.columns, place("__a__i").alias("__first"), F.greatest(place("__b__i"), place("__a__i")).alias("__last"))


def extremes(probes: DataFrame, rows: DataFrame, by: Sequence[str], ts: str, value: str, lo_us: int, hi_us: int, probe_id: str, few: int = FEW) -> DataFrame:
    """(probe_id, low, high): the least and the greatest value of rows with ts + lo <= t <= ts + hi; probes without rows are
    left out."""
    if pairs_are_few(probes, rows, by, ts, lo_us, hi_us, few):
        return interval_join(probes, rows, by, ts, lo_us, hi_us).groupBy(probe_id).agg(F.min(f"r_{value}").alias("low"), F.max(f"r_{value}").alias("high"))
    placed = in_places(rows.select(*by, ts, value), by, ts, [value])
    every = F.explode(F.sequence(F.lit(0), F.lit(TOP)))
    known = placed.select(*by, "__i", value, every.alias("__k")).groupBy(*by, "__k", F.expr("shiftright(__i, __k)").alias("__node")).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    asked = stretches(probes.select(probe_id, *by, ts), placed, by, ts, lo_us, hi_us).withColumn("n", F.explode(nodes_of("__first", "__last"))).select(probe_id, *by, F.col("n.k").alias("__k"), F.col("n.node").alias("__node"))
    return join_by(asked, known, [*by, "__k", "__node"]).groupBy(probe_id).agg(F.min("low").alias("low"), F.max("high").alias("high"))


def completions(orders: DataFrame, prints: DataFrame, by: Sequence[str], ts: str, order_id: str, tie: str, life_us: int, strict: bool) -> DataFrame:
    """(order_id, filled, done_at) of orders (…, side, limit, qty) against prints (…, price, size): see fills.level_fills.

    A node knows its volume up to each price.  An order asks the nodes of its stretch, in time order, how much lies beyond its
    limit; the node in which its quantity is reached is then asked part by part, STEP levels at a time, until few prints are
    left, which are paired.  An order asks some dozens of nodes, however many prints its stretch has."""
    placed = in_places(prints.select(*by, ts, tie, "price", "size"), by, ts, [tie])
    sign = lambda side: F.when(side == "buy", 1).otherwise(-1)  # noqa: E731  a sell is a buy with all prices negated
    levels = placed.withColumn("side", F.explode(F.array(F.lit("buy"), F.lit("sell")))).withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(TOP))))
    levels = levels.select(*by, "side", "__k", F.expr("shiftright(__i, __k)").alias("__node"), (sign(F.col("side")) * F.col("price")).alias("__px"), "size")
    node = [*by, "side", "__k", "__node"]
    upto = Window.partitionBy(*node).orderBy("__px").rangeBetween(Window.unboundedPreceding, 0)
    volumes = kept(levels.withColumn("__v", F.sum("size").over(upto)).select(*node, "__px", "__v").distinct(), "volumes")

    def ask(rows: DataFrame) -> DataFrame:
        """rows (order, need, k, node) with what their nodes hold beyond the limit, in time order, up to before each node."""
        found = asof(rows, volumes, node, "__px", ["__v"], allow_exact=not strict, prefix="__of", quote_ts="__at").drop("__at")
        along = Window.partitionBy(order_id).orderBy(F.expr("shiftleft(__node, __k)")).rowsBetween(Window.unboundedPreceding, 0)
        held = F.coalesce("__of__v", F.lit(0))
        return found.withColumn("__held", held).withColumn("__run", F.sum("__held").over(along)).drop("__of__v")

    def reached(asked: DataFrame) -> DataFrame:
        return asked.where((F.col("__run") >= F.col("__need")) & (F.col("__run") - F.col("__held") < F.col("__need"))).withColumn("__need", F.col("__need") - F.col("__run") + F.col("__held")).drop("__run", "__held")

    spans = stretches(orders.select(order_id, *by, ts, "side", "limit", "qty"), placed, by, ts, 1, life_us)
    asked = spans.withColumn("n", F.explode(nodes_of("__first", "__last"))).select(order_id, *by, "side", (sign(F.col("side")) * F.col("limit")).alias("__px"), F.col("qty").alias("__need"), F.col("n.k").alias("__k"), F.col("n.node").alias("__node"))
    first = kept(ask(asked), "asked")
    filled = first.groupBy(order_id).agg(F.least(F.max("__run"), F.first("__need")).alias("filled"))
    at = kept(reached(first), "reached")
    while (deepest := at.agg(F.max("__k")).first()[0] or 0) > STEP:
        parts = at.where(F.col("__k") > STEP).withColumn("__node", F.explode(F.sequence(F.shiftleft("__node", STEP), F.shiftleft("__node", STEP) + 2**STEP - 1))).withColumn("__k", F.col("__k") - STEP)
        at = kept(at.where(F.col("__k") <= STEP).unionByName(reached(ask(parts))), "reached")
    last = at.withColumn("__i", F.explode(F.expr("sequence(shiftleft(__node, __k), shiftleft(__node + 1, __k) - 1)"))).drop("__k", "__node")
    met = join_by(last, placed.select(*by, "__i", ts, "price", "size"), [*by, "__i"])
    px = sign(F.col("side")) * F.col("price")
    along = Window.partitionBy(order_id).orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    run = met.where((px < F.col("__px")) if strict else (px <= F.col("__px"))).withColumn("__run", F.sum("size").over(along))
    done = run.where(F.col("__run") >= F.col("__need")).groupBy(order_id).agg(F.min(ts).alias("done_at"))
    return filled.join(done, order_id, "left")
