"""As-of and interval joins: one shuffle by key, one sort, one window.

Both sides are laid on one timeline and the last (or next) quote is carried to each probe, so no probe is compared with
more than its neighbour.  A timeline that is too long for one task is cut into cells: the last quote of each cell is carried
over the cells of its key, a row per cell, and then into the cells.  Which keys are that long, and where their timelines are
cut, is measured; a feed without a key is one long timeline.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import in_ranges, join_by, kept

#: Rows of one key that a task may sort.
MOST_ROWS = 2_000_000
#: Rows of a longer key that a range of its timeline holds, about: a task sorts them, and its window keeps them once more.
CELL_ROWS = 1_000_000
#: Estimated bytes of all rows, per row that a task may sort, up to which nothing is measured.
SMALL = 16
#: Cells of a feed without a key that is too small to be measured: a day, if its time is in microseconds.
CELL = 86_400_000_000


def asof(
    probes: DataFrame, quotes: DataFrame, by: Sequence[str], ts: str, cols: Sequence[str], direction: str = "backward", allow_exact: bool = True,
    tolerance_us: int | None = None, lag_us: int = 0, tie: Sequence[str] = (), prefix: str = "", quote_ts: str = "quote_t", most_rows: int = MOST_ROWS,
) -> DataFrame:
    """probes with the columns ``cols`` of the nearest quote, and its time as ``quote_ts``; null where there is none.

    backward: last quote with ts <= probe (``<`` without ``allow_exact``); forward: first with ts >= probe.  ``lag_us`` is
    added to quote times first (availability).  Among quotes of one time, backward takes the last by
    ``tie``, forward the first.  A quote further away than ``tolerance_us`` counts as none.  Null keys meet null keys.  A key with more than ``most_rows`` rows is cut.
    """
    forward = direction == "forward"
    found = F.struct((F.col(ts) + lag_us).alias(quote_ts), *(F.col(c).alias(prefix + c) for c in cols))
    # a struct travels as a whole, so null columns of a matched quote stay null
    at = F.col(ts) + lag_us
    order = F.struct(*tie) if tie else F.struct(F.lit(0).alias("none"))
    left = quotes.select(*by, at.alias("__t"), F.lit(0 if allow_exact else 2).alias("__side"), order.alias("__tie"), found.alias("__found"))
    none, no_tie = F.lit(None).cast(left.schema["__found"].dataType), F.lit(None).cast(left.schema["__tie"].dataType)
    right = probes.select(*by, F.col(ts).alias("__t"), F.lit(1).alias("__side"), no_tie.alias("__tie"), none.alias("__found"), F.struct(*probes.columns).alias("__probe"))
    line = left.unionByName(right, allowMissingColumns=True)
    cut = in_cells(line, by, most_rows)
    key = list(by)
    if cut is not None:
        key = [*by, "__cell"]
        line = cut.withColumn("__carried", F.lit(1)).unionByName(carried(cut, by, forward), allowMissingColumns=True)
    flow = lambda c: F.col(c).desc() if forward else F.col(c).asc()
    first = [F.col("__carried").asc()] if cut is not None else []
    window = Window.partitionBy(*key).orderBy(*first, flow("__t"), F.col("__side").asc(), flow("__tie")).rowsBetween(Window.unboundedPreceding, 0)
    near = line.withColumn("__near", F.last("__found", ignorenulls=True).over(window)).where("__probe IS NOT NULL")
    if tolerance_us is not None:
        near = near.withColumn("__near", F.when(F.abs(F.col("__near")[quote_ts] - F.col("__t")) <= tolerance_us, F.col("__near")))
    return near.select("__probe.*", *(F.col("__near")[c].alias(c) for c in [quote_ts, *(prefix + c for c in cols)]))


def in_cells(line: DataFrame, by: Sequence[str], most_rows: int) -> DataFrame | None:
    """line with __cell, numbers that ascend with __t within a key, if any key needs to be cut; else None.

    Rows of keys with more than ``most_rows`` rows are dealt by ranges of key and time, of about CELL_ROWS rows or half of
    ``most_rows``, and written; a range is a cell, however long the timeline.  Bursts are cut like quiet times, only rows of one time stay together.  Where the
    optimiser's estimate says that all rows together are few, nothing is measured: keys stay whole, and a feed without a key
    is cut by the day."""
    short = None if by else line.withColumn("__cell", F.floor(F.col("__t") / CELL))
    if int(str(line._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL * most_rows:
        return short
    long = kept(line.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most_rows), "long-keys")
    rows = long.agg(F.sum("__n")).first()[0]
    if not rows:
        return short
    keys = long.select(*by)
    cut = in_ranges(join_by(line, keys, by), by, ["__t"], rows // max(1, min(most_rows // 2, CELL_ROWS)) + 1).withColumnRenamed("__range", "__cell")
    return cut.unionByName(join_by(line, keys, by, "left_anti").withColumn("__cell", F.lit(0))) if by else cut


def carried(cut: DataFrame, by: Sequence[str], forward: bool) -> DataFrame:
    """For each cell with probes, the quote that the cells before it (``forward``: behind it) end with, as a row that comes
    first in the cell."""
    key = F.when(F.col("__found").isNotNull(), F.struct("__t", "__tie"))
    edge = (F.min_by if forward else F.max_by)("__found", key)
    steps = cut.groupBy(*by, "__cell").agg(edge.alias("__found"), F.count_if(F.col("__found").isNull()).alias("__asked"))
    order = F.col("__cell").desc() if forward else F.col("__cell").asc()
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # a row per cell
    given = steps.withColumn("__found", F.last("__found", ignorenulls=True).over(before)).where("__asked > 0 AND __found IS NOT NULL")
    return given.select(*by, "__cell", "__found", F.lit(0).alias("__carried"))


def asof_at(probes: DataFrame, quotes: DataFrame, by: Sequence[str], ts: str, cols: Sequence[str], offsets_us: dict[str, int], **how) -> DataFrame:
    """A row per probe and named offset, with the quote as of the probe's time plus that offset: (…, step, at, quote)."""
    steps = F.explode(F.array(*(F.struct(F.lit(n).alias("step"), F.lit(v).cast("long").alias("offset")) for n, v in offsets_us.items())))
    spread = probes.withColumn("__s", steps).select(*(c for c in probes.columns if c != ts), F.col(ts).alias("probe_t"), "__s.step", (F.col(ts) + F.col("__s.offset")).alias(ts))
    return asof(spread, quotes, by, ts, cols, **how)


def interval_join(probes: DataFrame, rows: DataFrame, by: Sequence[str], ts: str, lo_us: int, hi_us: int, how: str = "inner", bucket_us: int | None = None) -> DataFrame:
    """Pairs with ``probe.ts + lo_us <= row.ts <= probe.ts + hi_us``; rows' columns other than ``by`` get the prefix r_.

    The join is an equi-join on key and time bucket: probes are repeated for the buckets that their interval touches (two
    where a bucket is as long as the interval, as it is without ``bucket_us``), rows are not, so a pair appears once.
    """
    bucket = bucket_us or max(1, hi_us - lo_us)
    first, last = F.floor((F.col(ts) + lo_us) / bucket), F.floor((F.col(ts) + hi_us) / bucket)
    left = probes.withColumn("__b", F.explode(F.sequence(first, last)))
    right = rows.select(*by, *(F.col(c).alias(f"r_{c}") for c in rows.columns if c not in by), F.floor(F.col(ts) / bucket).alias("__b"))
    pairs = left.join(right, [*by, "__b"]).where((F.col(f"r_{ts}") >= F.col(ts) + lo_us) & (F.col(f"r_{ts}") <= F.col(ts) + hi_us)).drop("__b")
    if how == "inner":
        return pairs
    keys = probes.columns
    return probes.join(pairs, keys, "left")


def range_lookup(rows: DataFrame, bands: DataFrame, value: str, lo: str, hi: str, cols: Sequence[str], most: int = 64) -> DataFrame:
    """rows with the columns of each band lo <= value < hi, nulls where there is none; a null end is open, bands may overlap.

    Up to ``most`` bands are broadcast and tried one by one.  More are indexed: the values' span is cut into a grid of some
    cells per band, a band's cells are the union of few dyadic nodes (two a level at most), and a value looks up the nodes
    that hold its cell, one a level.  That is an equi-join, in which a band and a value meet once; the ends are compared then."""
    named = bands.select(F.col(lo).alias("__lo"), F.col(hi).alias("__hi"), *cols)
    inside = (F.col("__lo").isNull() | (F.col(value) >= F.col("__lo"))) & (F.col("__hi").isNull() | (F.col(value) < F.col("__hi")))
    n = named.count()
    if n <= most:
        return rows.join(F.broadcast(named), inside, "left").drop("__lo", "__hi")
    number = lambda c, kind: (F.unix_date(c) if kind == "date" else F.unix_micros(c) if kind == "timestamp" else F.col(c)).cast("double")
    of, at = dict(named.dtypes), dict(rows.dtypes)[value]
    ends = named.agg(F.min(number("__lo", of["__lo"])).alias("a"), F.max(number("__lo", of["__lo"])).alias("b"), F.min(number("__hi", of["__hi"])).alias("c"), F.max(number("__hi", of["__hi"])).alias("d")).first()
    known = [x for x in ends if x is not None] or [0.0]
    low, span = min(known), (max(known) - min(known)) or 1.0
    levels = min(30, n.bit_length() + 2)
    # rises with the value, so a value inside a band has its cell inside the band's; beyond the ends are the outermost cells
    cell = lambda x: F.when(x.isNotNull(), F.least(F.greatest(F.floor((x - low) / span * 2.0**levels), F.lit(0)), F.lit(2**levels - 1)))
    nodes = f"""explode(flatten(transform(sequence(0, {levels}), k -> filter(array(
        if(shiftright(__p + shiftleft(1L, k) - 1, k) < shiftright(__q + 1, k) AND shiftright(__p + shiftleft(1L, k) - 1, k) % 2 = 1, named_struct('k', k, 'node', shiftright(__p + shiftleft(1L, k) - 1, k)), NULL),
        if(shiftright(__p + shiftleft(1L, k) - 1, k) < shiftright(__q + 1, k) AND shiftright(__q + 1, k) % 2 = 1, named_struct('k', k, 'node', shiftright(__q + 1, k) - 1), NULL)), x -> x IS NOT NULL))))"""
    placed = named.withColumns({"__p": F.coalesce(cell(number("__lo", of["__lo"])), F.lit(0)), "__q": F.coalesce(cell(number("__hi", of["__hi"])), F.lit(2**levels - 1))})
    index = kept(placed.withColumn("__n", F.expr(nodes)).select("__lo", "__hi", *cols, F.col("__n.k").alias("__k"), F.col("__n.node").alias("__node")), "bands")
    used = sorted(r["__k"] for r in index.select("__k").distinct().collect())  # levels
    # a node high up holds the cells of many values: it is dealt over parts, all of which get its bands
    parts = F.greatest(F.lit(1), F.shiftleft(F.lit(1), 8) / F.pow(F.lit(2.0), levels - F.col("__k"))).cast("int")
    index = index.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    valued = kept(rows.withColumn("__row", F.monotonically_increasing_id()), "valued")  # numbered once, then read
    probes = valued.select("__row", value, F.explode(F.array(*map(F.lit, used))).alias("__k")).withColumn("__node", F.floor(cell(number(value, at)) / F.pow(F.lit(2.0), F.col("__k"))))
    probes = probes.withColumn("__part", F.pmod(F.xxhash64("__row"), parts).cast("int"))
    met = probes.join(index, ["__k", "__node", "__part"]).where(inside).select("__row", *cols)
    return valued.join(met, "__row", "left").drop("__row")
