"""Order within keys without a task that holds a key: ranges, counts carried between ranges, ranks inside them.

Rows are dealt by ranges of (key, order) and written once.  A key's rows then lie in one range or in neighbouring ones, so
a row's rank is its rank inside its range, after the key's rows in the ranges before.  What is gathered per key is one
number for each range it reaches into.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tape import scratch


def in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], ranges: int | None = None) -> DataFrame:
    """df as a written table dealt by ranges of (by, order), with the number of each row's range as __range.

    Rows that are equal in all of these share a range.  ``ranges`` fixes how many there are at most; else Spark's shuffle
    partitions do."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "ranges")
    dealt = df.repartitionByRange(ranges, *by, *order) if ranges else df.repartitionByRange(*by, *order)
    ranged = dealt.withColumn("__range", F.spark_partition_id())
    ranged.write.parquet(path)
    return spark.read.schema(ranged.schema).parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a written table, for what is read more than once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_by(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """left joined to right on equal columns, nulls meeting nulls; the columns appear once."""
    named = right.withColumnsRenamed({c: f"__on_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__on_{c}"))
    return left.join(named, same, how).drop(*(f"__on_{c}" for c in on))


def starts(ranged: DataFrame, by: Sequence[str], weight: Column) -> DataFrame:
    """(by…, __range, __before, __all): the key's weight in the ranges before this one, and in all."""
    sums = ranged.groupBy(*by, "__range").agg(F.sum(weight).alias("__sum"))
    key = Window.partitionBy(*(by or [F.lit(0)]))  # a row per key and range
    before = F.sum("__sum").over(key.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select(*by, "__range", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__sum").over(key).alias("__all"))


def with_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], rank: str = "rank", size: str | None = None, ranges: int | None = None) -> DataFrame:
    """df with each row's place among those of its key, from 1, and with ``size`` how many those are.  ``order`` should leave
    no ties, or tied rows get their places in any order."""
    ranged = in_ranges(df, by, order, ranges)
    inside = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order))
    placed = join_by(ranged.withColumn("__inside", inside), starts(ranged, by, F.lit(1)), [*by, "__range"])
    return placed.select(*df.columns, (F.col("__before") + F.col("__inside")).alias(rank), *([F.col("__all").alias(size)] if size else []))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, quantiles: Sequence[float], ranges: int | None = None) -> DataFrame:
    """(by…, q, v): the quantiles of a column per key, interpolated between neighbours, nulls left out; exact, by ranks.

    Equal values are counted before anything is shuffled by range.  The two values on which a quantile lies are the ones
    whose ranks reach over its position, so two rows per key and quantile are all that is gathered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("__n"))
    ranged = in_ranges(kept(counts, "counts"), by, ["v"], ranges)  # ranges are found by a look at the rows before they are dealt
    upto = F.sum("__n").over(Window.partitionBy(*by, "__range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = join_by(ranged.withColumn("__upto", upto), starts(ranged, by, F.col("__n")), [*by, "__range"])
    last = F.col("__before") + F.col("__upto") - 1  # places from 0
    placed = placed.withColumns({"__first": last - F.col("__n") + 1, "__last": last})
    holds = lambda place: (place >= F.col("__first")) & (place <= F.col("__last"))
    at = lambda q: q * (F.col("__all") - 1)
    asked = placed.withColumn("q", F.explode(F.filter(F.array(*map(F.lit, quantiles)), lambda q: holds(F.floor(at(q))) | holds(F.ceil(at(q))))))
    q = F.col("q")
    ends = asked.groupBy(*by, "q").agg(F.max(F.when(holds(F.floor(at(q))), F.col("v"))).alias("__a"), F.max(F.when(holds(F.ceil(at(q))), F.col("v"))).alias("__b"), F.max(at(q) - F.floor(at(q))).alias("__part"))
    return ends.select(*by, "q", (F.col("__a") + F.when(F.col("__part") > 0, (F.col("__b") - F.col("__a")) * F.col("__part")).otherwise(0.0)).alias("v"))


def quantile_columns(df: DataFrame, by: Sequence[str], value: str, named: dict[str, float], ranges: int | None = None) -> DataFrame:
    """(by…, a column per name): exact_quantiles with a row per key."""
    long = exact_quantiles(df, by, value, sorted(set(named.values())), ranges)
    return long.groupBy(*by).agg(*(F.max(F.when(F.col("q") == q, F.col("v"))).alias(name) for name, q in named.items()))
