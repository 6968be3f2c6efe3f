"""Series per key: changes, runs, streaks, cumulative curves, trailing ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changes_only(df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows in which any of cols differs from the row before; the first row of a key stays."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = df.withColumn("__before", F.lag(F.struct(*cols)).over(w))
    return before.where(F.col("__before").isNull() | ~F.struct(*cols).eqNullSafe(F.col("__before"))).drop("__before")


def first_of(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def with_islands(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, gap: Column | None = None) -> DataFrame:
    """df with island: the number of the run of equal values; ``gap`` marks rows that start a new run all the same."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(F.lit(1)).over(w).isNull()
    if gap is not None:
        new = new | F.coalesce(gap, F.lit(False))
    return df.withColumn("__new", new.cast("int")).withColumn("island", F.sum("__new").over(w)).drop("__new")


def with_streak(df: DataFrame, by: Sequence[str], ts: str, up: str, step: int) -> DataFrame:
    """df with prior_up and streak: the outcome before, only if its window is the one directly before, and the signed
    number of equal outcomes that end there."""
    w = Window.partitionBy(*by).orderBy(ts)
    adjacent = F.lag(ts).over(w) + step == F.col(ts)
    runs = with_islands(df, by, [ts], up, ~adjacent)
    inside = Window.partitionBy(*by, "island").orderBy(ts)
    counted = runs.withColumn("__len", F.row_number().over(inside) * F.when(F.col(up), 1).otherwise(-1))
    prior = lambda c: F.when(F.lag(ts).over(w) + step == F.col(ts), F.lag(c).over(w))
    return counted.withColumns({"prior_up": prior(up), "streak": F.coalesce(prior("__len"), F.lit(0))}).drop("__len", "island")


def with_drawdown(df: DataFrame, by: Sequence[str], order: Sequence[str], pnl: str) -> DataFrame:
    """df with cum, peak and drawdown of the running sum; the peak starts with the first sum, not with 0."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cum", F.sum(pnl).over(w)).withColumn("peak", F.max("cum").over(w)).withColumn("drawdown", F.col("peak") - F.col("cum"))


def trailing(df: DataFrame, by: Sequence[str], ts: str, width_us: int, include_now: bool = True) -> Window:
    """The window (ts - width, ts] on a long time column."""
    return Window.partitionBy(*by).orderBy(ts).rangeBetween(-width_us + 1, 0 if include_now else -1)


def trailing_at(probes: DataFrame, rows: DataFrame, by: Sequence[str], ts: str, aggregates: dict[str, tuple[Column, int | None]]) -> DataFrame:
    """probes with aggregates over rows in (ts - width, ts]; width None is everything so far.

    Both sides share one timeline, rows before probes at equal times, so one shuffle serves every aggregate.  An
    aggregate's column refers to rows' columns; probes contribute nulls.
    """
    line = rows.withColumn("__side", F.lit(0)).unionByName(probes.select(*by, ts, F.lit(1).alias("__side"), F.struct(*probes.columns).alias("__probe")), allowMissingColumns=True)
    out = line
    for name, (column, width) in aggregates.items():
        w = Window.partitionBy(*by).orderBy(ts)
        w = w.rangeBetween(Window.unboundedPreceding if width is None else -width + 1, 0)
        out = out.withColumn(name, column.over(w))
    return out.where("__probe IS NOT NULL").select("__probe.*", *aggregates)
