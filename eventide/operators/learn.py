"""Models on tapes: walk-forward folds, fits with Spark ML, calibration, ranking measures, bootstrap."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from .asof import asof
from .ranks import exact_quantiles, in_ranges, kept
from .series import first_of


def date_folds(rows: DataFrame, day: str, folds: int) -> DataFrame:
    """(day, fold): equal blocks of the distinct days in order.  The window runs over one row per day."""
    days = rows.select(day).distinct()
    place = F.row_number().over(Window.orderBy(day)) - 1
    return days.select(day, F.floor(place * folds / F.count(F.lit(1)).over(Window.partitionBy())).alias("fold"))


def logistic(features: Sequence[str], label: str):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    filled = [f"{f}__f" for f in features]
    return Pipeline(stages=[Imputer(inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__v"), StandardScaler(inputCol="__v", outputCol="__x", withMean=True), LogisticRegression(featuresCol="__x", labelCol=label, maxIter=30, regParam=0.01)])


def boosted(features: Sequence[str], label: str):
    """Boosted trees; missing features take the fit's mean, as trees do not split on them."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler

    filled = [f"{f}__f" for f in features]
    return Pipeline(stages=[Imputer(inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__v"), GBTClassifier(featuresCol="__v", labelCol=label, maxIter=20, maxDepth=3, seed=7)])


def walk_forward(rows: DataFrame, features: Sequence[str], label: str, day: str, folds: int, embargo_days: int, model: Callable) -> DataFrame:
    """(event_id, fold, y, p): each fold after the first is scored by a model fitted on what lies before it, less the
    embargo.  The driver loops over the folds, a handful; fits and scores are distributed."""
    from pyspark.ml.functions import vector_to_array

    placed = rows.join(date_folds(rows, day, folds), day)
    starts = {r[0]: r[1] for r in placed.groupBy("fold").agg(F.min(day)).collect()}  # a row per fold
    out = None
    for fold in sorted(starts)[1:]:
        fit = placed.where(F.col(day) < starts[fold] - embargo_days)
        if fit.agg(F.countDistinct(label)).first()[0] < 2:
            continue
        scored = model(features, label).fit(fit).transform(placed.where(F.col("fold") == fold))
        part = scored.select("event_id", "fold", F.col(label).alias("y"), vector_to_array("probability")[1].alias("p"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else placed.select("event_id", "fold", F.col(label).alias("y"), F.lit(None).cast("double").alias("p")).limit(0)


def pool(blocks: pd.DataFrame) -> pd.DataFrame:
    """Blocks (lo, hi, n, total) in order of score, with neighbours whose means do not rise pooled into one.

    Pooled blocks can be pooled again: blocks of parts that follow each other, pooled together, are the blocks of the whole."""
    out: list[list[float]] = []
    for lo, hi, n, total in blocks[["lo", "hi", "n", "total"]].itertuples(index=False):
        out.append([lo, hi, n, total])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, hi, n, total = out.pop()
            out[-1] = [out[-1][0], hi, out[-1][2] + n, out[-1][3] + total]
    return pd.DataFrame(out, columns=["lo", "hi", "n", "total"])


def isotonic_steps(scored: DataFrame, by: Sequence[str], p: str, y: str, ranges: int | None = None) -> DataFrame:
    """(by…, lo, hi, n, v): the isotonic fit of y on p, a row per step, for every value of ``by`` in one job.

    Equal scores are summed first; ranges of (by, score) are pooled apart, then the blocks of a key's ranges together, so what a
    task gathers per key is blocks, not rows.  Rows without a score or an outcome take no part."""
    rows = scored.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(p).cast("double").alias("lo")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("total"))
    ranged = in_ranges(rows, by, ["lo"], ranges).withColumn("hi", F.col("lo"))
    schema = T.StructType([*(ranged.schema[c] for c in by), *(T.StructField(c, T.DoubleType()) for c in ("lo", "hi", "n", "total"))])

    def pooled(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = pool(part.sort_values("lo"))
        for i, c in enumerate(by):
            out.insert(i, c, pd.Series([keys[i]] * len(out), dtype=part[c].dtype))
        return out

    first = ranged.groupBy(*by, "__range").applyInPandas(pooled, schema)
    steps = first.groupBy(*by).applyInPandas(pooled, schema) if by else first.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(lambda keys, part: pooled((), part), schema)
    return steps.select(*by, "lo", "hi", F.col("n").cast("long").alias("n"), (F.col("total") / F.col("n")).alias("v"))


def isotonic(scored: DataFrame, p: str, y: str, by: Sequence[str] = (), fit: DataFrame | None = None) -> DataFrame:
    """scored with calibrated: the isotonic fit of outcome on score per value of ``by``, made on ``fit`` (scored itself, if not
    given), which should hold out-of-fold scores only.  Between two steps it runs straight from one to the other; beyond the
    outermost it stays; null without a score or without a fit."""
    scored = kept(scored, "scored")  # read for the fit and for two look-ups
    steps = isotonic_steps(scored if fit is None else fit, by, p, y)
    below = asof(scored, steps.withColumn(p, F.col("lo")), by, p, ["hi", "v"], prefix="__a_", quote_ts="__a_lo")
    both = asof(below, steps.withColumn(p, F.col("lo")), by, p, ["v"], direction="forward", prefix="__b_", quote_ts="__b_lo")
    x, hi, a, b = F.col(p).cast("double"), F.col("__a_hi"), F.col("__a_v"), F.col("__b_v")
    value = F.when(x.isNull(), None).when(a.isNull(), b).when((x <= hi) | b.isNull(), a).otherwise(a + (b - a) * (x - hi) / (F.col("__b_lo") - hi))
    return both.withColumn("calibrated", value).select(*scored.columns, "calibrated")


def auc(rows: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve by ranks, ties at their mean; one row per distinct score is sorted, not every row."""
    steps = rows.groupBy(*by, score).agg(F.count_if(label).alias("n1"), F.count_if(~F.col(label)).alias("n0"))
    below = F.coalesce(F.sum("n0").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = steps.withColumn("__w", F.col("n1") * (below + F.col("n0") / 2))
    return won.groupBy(*by).agg(S.ratio(F.sum("__w"), F.sum("n1") * F.sum("n0")).alias("auc"))


def margin_picks(rows: DataFrame, p: str, price: Column, margin: float, by: Sequence[str], ts: str) -> DataFrame:
    """The first row per group whose probability exceeds the price by the margin."""
    return first_of(rows.where(F.col(p) - price >= margin), by, [F.col(ts), F.col("event_id")])


def slices(rows: DataFrame, score: str, quantiles: Sequence[float], outcome: Column) -> DataFrame:
    """(q, n, rate) of the rows at or above each quantile of the score."""
    cuts = exact_quantiles(rows, [], score, quantiles).withColumnRenamed("v", "__t")
    hit = rows.join(F.broadcast(cuts), F.col(score) >= F.col("__t"))  # a row per quantile asked for
    return hit.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("rate"))


def bootstrap_drawdown(daily: DataFrame, day: str, pnl: str, replicas: int, length: int) -> DataFrame:
    """(rep, max_drawdown) of series drawn with replacement; draws come from a hash, so every run gives the same.  daily
    has one row per day."""
    w = Window.orderBy(day)
    numbered = daily.select(F.col(pnl).alias("s"), (F.row_number().over(w) - 1).cast("long").alias("i"))
    n = numbered.agg(F.count(F.lit(1)).alias("n"))
    spark = daily.sparkSession
    draws = spark.range(1, replicas + 1).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(length - 1)).cast("array<long>")).alias("k"))
    digest = F.conv(F.substring(F.md5(F.concat_ws(",", F.col("rep").cast("string"), F.col("k").cast("string"))), 1, 8), 16, 10).cast("long")
    drawn = draws.join(F.broadcast(n), F.lit(True)).withColumn("i", digest % F.col("n")).join(numbered, "i")
    along = Window.partitionBy("rep").orderBy("k")
    cum = drawn.withColumn("cum", F.sum("s").over(along))
    return cum.withColumn("dd", F.max("cum").over(along) - F.col("cum")).groupBy("rep").agg(F.max("dd").alias("max_drawdown"))
