"""Grids of rules: enumeration, evaluation in one pass, splits and judgement."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tape import scratch


def conjunction(rules: Sequence[tuple[str, str, float]]) -> Column:
    """(feature, op, threshold) rules joined by AND; nulls and NaN fail every rule."""
    ops = {"<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "==": lambda c, v: c == v}

    def one(feature: str, op: str, threshold: float) -> Column:
        c = F.col(feature).cast("double")
        return F.coalesce(~F.isnan(c) & ops[op](c, F.lit(threshold)), F.lit(False))

    return reduce(lambda a, b: a & b, (one(*r) for r in rules), F.lit(True))


def rules_hold(features: Column, rules: Column) -> Column:
    """Whether every rule of array<struct<feature,op,thr>> holds on map<string,double>: rules as data, not as code."""

    def one(r):
        x = features[r["feature"]]
        return F.coalesce(~F.isnan(x) & F.when(r["op"] == ">", x > r["thr"]).otherwise(x < r["thr"]), F.lit(False))

    return F.forall(rules, one)


def enumerate_configs(features: DataFrame, sides: Sequence[str], ops: Sequence[str] = (">", "<")) -> DataFrame:
    """(cid, feature, op, thr, side) for each (feature, thr) row, op and side, numbered in a fixed order."""
    spread = features.select("feature", "thr", F.explode(F.array(*map(F.lit, ops))).alias("op")).withColumn("side", F.explode(F.array(*map(F.lit, sides))))
    return spread.withColumn("cid", F.concat_ws("|", "feature", "op", F.format_string("%.2f", "thr"), "side"))


def split_metrics(trades: DataFrame, by: Sequence[str], pnl: str, day: str | None = None) -> DataFrame:
    """n, total, mean, t, profit factor, win rate; profit factor is null without losses, t is 0 without spread."""
    sd = F.stddev_samp(pnl)
    gain, loss = F.sum(F.when(F.col(pnl) > 0, F.col(pnl)).otherwise(0.0)), -F.sum(F.when(F.col(pnl) < 0, F.col(pnl)).otherwise(0.0))
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(pnl).alias("total"), F.avg(pnl).alias("mean"),
        F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise(F.avg(pnl) / (sd / F.sqrt(F.count(F.lit(1))))).alias("t"),
        F.when(loss > 0, gain / loss).alias("pf"), F.avg((F.col(pnl) > 0).cast("int")).alias("wr"),
    )


#: Thresholds of a feature up to which a value is compared with each of them in the JVM; more are searched in Python.
FEW_CUTS = 64
SUMS = ("n", "total", "squares", "gain", "loss", "wins")


def score_configs(decisions: DataFrame, configs: DataFrame, split: Sequence[str], pay: dict[str, Column], most: int = 250_000) -> DataFrame:
    """(cid, split…, n, total, mean, t, pf, wr): what each rule of ``configs`` (cid, feature, op, thr, side) makes of the decisions
    on which ``feature op thr`` holds; op is one of > >= < <=, ``pay`` gives the result of a decision per side.

    A decision is placed once per feature among the feature's thresholds: 2i between the thresholds i-1 and i, 2i+1 on
    threshold i.  Results are summed per place, split and side, and a rule is a sum over the places on one side of its
    threshold, that is a running sum.  So the cost is decisions plus rules; no decision meets a rule.  Null and NaN fail
    every rule, a null result is no trade, rules without trades give no row; pf is null without losses, t is 0 without
    spread.  Up to ``most`` rules at once are a dimension that is sent to the tasks; more of them take passes over the decisions.
    """
    spark = decisions.sparkSession
    shaped = configs.select("cid", "feature", "op", F.col("thr").cast("double").alias("thr"), "side")
    first = shaped.limit(most + 1).toPandas()
    if len(first) <= most:
        return _scored(decisions, first, split, pay, shaped.schema)
    path = scratch(spark, "rules")
    shaped.write.parquet(path)
    rules, out = spark.read.parquet(path), None
    passes = -(-rules.count() // most) * 2
    for i in range(passes):  # half full on average, so that the hash's spread still fits
        part = _scored(decisions, rules.where(F.pmod(F.xxhash64("feature", "thr", "cid"), F.lit(passes)) == i).toPandas(), split, pay, shaped.schema)
        out = part if out is None else out.unionByName(part)
    return out


def _scored(decisions: DataFrame, rules: pd.DataFrame, split: Sequence[str], pay: dict[str, Column], schema) -> DataFrame:
    cuts = {f: np.unique(g["thr"].dropna().to_numpy()) for f, g in rules.groupby("feature")}
    unknown = sorted(set(cuts) - set(decisions.columns))
    if unknown:
        raise ValueError(f"rules on features that the decisions lack: {unknown[:5]}")
    spark = decisions.sparkSession
    if not cuts:
        return _metrics(spark.createDataFrame([], schema).join(decisions.select(*split), F.lit(False)), split, {s: F.lit(0.0) for s in SUMS})
    rules = rules[rules["thr"].notna() & rules["op"].isin([">", ">=", "<", "<="])]
    among = [int(np.searchsorted(cuts[f], t)) for f, t in zip(rules["feature"], rules["thr"])]
    # the place from which, or up to which, a rule holds
    edges = rules.assign(place=[2 * i + {">": 2, ">=": 1, "<": 0, "<=": 1}[op] for i, op in zip(among, rules["op"])], __above=rules["op"].str.startswith(">"))
    edges = spark.createDataFrame(edges[["cid", "feature", "side", "place", "__above"]], T.StructType([schema["cid"], schema["feature"], schema["side"], T.StructField("place", T.IntegerType()), T.StructField("__above", T.BooleanType())]))

    def place(feature: str) -> Column:
        at, x = cuts[feature], F.col(feature).cast("double")
        if len(at) <= FEW_CUTS:
            passed = sum(((x > F.lit(float(t))).cast("int") + (x >= F.lit(float(t))).cast("int") for t in at), F.lit(0))
            return F.when(x.isNotNull() & ~F.isnan(x), passed)

        @F.pandas_udf("int")
        def among(x: pd.Series) -> pd.Series:
            found = pd.Series(np.searchsorted(at, x.to_numpy(), "left") + np.searchsorted(at, x.to_numpy(), "right"), index=x.index)
            return found.where(x.notna()).astype("Int32")

        return among(x)

    placed = decisions.select(*split, *(c.cast("double").alias(f"__pay_{s}") for s, c in pay.items()), F.array(*(F.struct(F.lit(f).alias("feature"), place(f).alias("place")) for f in cuts)).alias("__at"))
    long = placed.withColumn("__at", F.explode("__at")).select("*", "__at.feature", "__at.place").where("place IS NOT NULL")
    sums = []
    for side in pay:
        p = F.col(f"__pay_{side}")
        each = (F.count(p), F.sum(p), F.sum(p * p), F.sum(F.when(p > 0, p).otherwise(0.0)), F.sum(F.when(p < 0, -p).otherwise(0.0)), F.count_if(p > 0))
        sums.append(F.struct(F.lit(side).alias("side"), *(F.coalesce(c, F.lit(0)).alias(name) for c, name in zip(each, SUMS))))
    cube = long.groupBy("feature", "place", *split).agg(F.array(*sums).alias("__s")).select("feature", "place", *split, F.explode("__s").alias("__s")).select("feature", "place", *split, "__s.*")
    path = scratch(spark, "cube")
    cube.write.parquet(path)
    cube = spark.read.parquet(path)
    # a rule stands at its edge in each of its feature's splits
    asked = edges.join(cube.select("feature", *split).distinct(), "feature")
    line = cube.unionByName(asked, allowMissingColumns=True)
    key = Window.partitionBy("feature", "side", *split)  # a row per place and per rule
    upto, from_ = (key.orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("place"), F.desc("place")))
    summed = line.withColumns({f"__{s}": F.when(F.col("__above"), F.sum(s).over(from_)).otherwise(F.sum(s).over(upto)) for s in SUMS}).where("cid IS NOT NULL")
    return _metrics(summed, split, {s: F.col(f"__{s}") for s in SUMS})


def _metrics(rows: DataFrame, split: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    n, total, squares, gain, loss, wins = (F.coalesce(sums[s], F.lit(0)) for s in SUMS)
    mean = total / n
    spread = (squares - total * mean) / (n - 1)
    flat = (n < 2) | (spread <= 1e-12 * squares / n)  # what rounding leaves of no spread at all
    return rows.where(n > 0).select(
        "cid", *split, n.cast("long").alias("n"), total.alias("total"), mean.alias("mean"), F.when(flat, 0.0).otherwise(mean / F.sqrt(spread / n)).alias("t"), F.when(loss > 0, gain / loss).alias("pf"), (wins / n).alias("wr")
    )


def max_drawdown(trades: DataFrame, by: Sequence[str], day: str, order: Sequence[str], pnl: str) -> DataFrame:
    """(by…, max_drawdown): the largest fall of the running sum of pnl, in ``order``, from its highest value so far.

    Trades are sorted within a day only; a day is then one row (its sum, highest, lowest and own largest fall), and those
    rows are enough for the falls that cross days.  The highest value starts with the first trade's.
    """
    inside = Window.partitionBy(*by, day).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = trades.select(*by, day, *(c for c in order if c not in (*by, day)), pnl).withColumn("__cum", F.sum(pnl).over(inside)).withColumn("__fall", F.max("__cum").over(inside) - F.col("__cum"))
    days = run.groupBy(*by, day).agg(F.sum(pnl).alias("__sum"), F.max("__cum").alias("__top"), F.min("__cum").alias("__low"), F.max("__fall").alias("__fall"))
    before = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0.0)))
    fall = F.greatest("__fall", F.max(F.col("__before") + F.col("__top")).over(before) - F.col("__before") - F.col("__low"))
    return days.withColumn("__fall", fall).groupBy(*by).agg(F.max("__fall").alias("max_drawdown"))


def clustered_t(trades: DataFrame, by: Sequence[str], cluster: str, pnl: str) -> DataFrame:
    """t of the cluster sums: trades of one day are not independent."""
    days = trades.groupBy(*by, cluster).agg(F.sum(pnl).alias("__day"))
    sd = F.stddev_samp("__day")
    return days.groupBy(*by).agg(F.count(F.lit(1)).alias("clusters"), F.sum("__day").alias("total"), F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise(F.avg("__day") / (sd / F.sqrt(F.count(F.lit(1))))).alias("t"))


def funnel(board: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """(place, stage, remaining): how many rows pass each stage and all before it, in one pass."""
    passed, cols = F.lit(True), []
    for i, (_, test) in enumerate(stages):
        passed = passed & F.coalesce(test, F.lit(False))
        cols.append(F.count_if(passed).alias(f"s{i}"))
    counted = board.agg(*cols)
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(name).alias("stage"), F.col(f"s{i}").alias("remaining")) for i, (name, _) in enumerate(stages))))
    return counted.select(rows.alias("r")).select("r.*")
