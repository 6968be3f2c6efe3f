"""Reading and writing tapes: partitioned Parquet, sealed ranges, evolving schemas, incremental builds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder that spark.checkpoint.dir names; where it is unset on a local master (tests), one of
    its own.  A cluster has to name one: a temporary folder would be another one on each machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def write_tape(rows: DataFrame, channel: str, date: Column, order: Sequence[str], root: str | None = None) -> str:
    """Parquet by channel and date, sorted within files; rows of one partition may span files, so a hot channel does not
    end in one task."""
    root = root or scratch(rows.sparkSession, "tape")
    dated = rows.withColumn("channel", F.col(channel)).withColumn("date", date)
    spread = dated.hint("rebalance", "channel", "date").sortWithinPartitions("channel", "date", *order)
    spread.write.partitionBy("channel", "date").option("compression", "zstd").parquet(root)
    return root


def read_tape(spark: SparkSession, root: str, channel: str, lo: int | None, hi: int | None) -> DataFrame:
    """One channel between two dates, ends included; both are partition columns, so other files are not opened."""
    rows = spark.read.parquet(root).where(F.col("channel") == channel)
    if lo is not None:
        rows = rows.where(F.col("date") >= lo)
    return rows if hi is None else rows.where(F.col("date") <= hi)


def unsealed(rows: DataFrame, day: str, lo, hi) -> DataFrame:
    """rows outside the sealed range of days lo..hi."""
    return rows.where(~F.col(day).between(lo, hi))


def assert_unsealed(lo, hi, asked: Sequence) -> None:
    """Raises if one of the asked days lies in the sealed range."""
    touched = [d for d in asked if lo <= d <= hi]
    if touched:
        raise PermissionError(f"sealed: {touched[:5]}")


def with_schema(rows: DataFrame, schema: str, defaults: dict[str, object]) -> DataFrame:
    """rows with exactly these columns and types: values that do not convert are null, missing columns their default."""
    wanted = T.StructType.fromDDL(schema)
    return rows.select(*((F.col(f.name).try_cast(f.dataType) if f.name in rows.columns else F.lit(defaults.get(f.name)).cast(f.dataType)).alias(f.name) for f in wanted))


def read_many(frames: dict[str, DataFrame]) -> DataFrame:
    """The union of tables, missing columns null, with the name each row came from as src."""
    out = None
    for name, df in frames.items():
        df = df.withColumn("src", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def finished(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The partitions that a build has finished: its manifest, empty before the first."""
    manifest = f"{path}/_finished"
    fs = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    there = fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
    return spark.read.schema(schema).parquet(manifest) if there else spark.createDataFrame([], schema)


def build_missing(rows: DataFrame, path: str, date: str, per_commit: int | None = None) -> None:
    """Writes the partitions of ``date`` that the manifest beside them does not name; run again, it does nothing for those.

    A commit writes some partitions whole (all, or ``per_commit`` of them) in place of what a broken run may have left of them,
    and then names them in the manifest.  So a run that ends anywhere is taken up by the next one, with the same result.
    """
    spark = rows.sparkSession
    schema = T.StructType([rows.schema[date]])
    todo = rows.join(finished(spark, path, schema), date, "left_anti")
    days = [r[0] for r in todo.select(date).distinct().orderBy(date).collect()]  # a row per partition
    for i in range(0, len(days), per_commit or max(1, len(days))):
        some = days[i : i + (per_commit or len(days))]
        rows.where(F.col(date).isin(some)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)
        finish(spark, path, schema, some)


def finish(spark: SparkSession, path: str, schema: T.StructType, days: Sequence) -> None:
    spark.createDataFrame([(d,) for d in days], schema).coalesce(1).write.mode("append").parquet(f"{path}/_finished")


def late_materialised(spark: SparkSession, path: str, key: str, wanted: Column, columns: Sequence[str]) -> DataFrame:
    """(key, columns…) of the rows for which ``wanted`` holds, where ``columns`` are wide and ``wanted`` is told by narrow ones.

    The first pass reads the narrow columns only and writes the keys with the file each row is in.  The second opens just those
    files, and of them, by the keys' range, just row groups and pages that can hold one.  ``key`` names a row.
    """
    rows = spark.read.parquet(path)
    chosen = rows.where(wanted).select(key, F.col("_metadata.file_path").alias("__file"))
    kept = scratch(spark, "keys")
    chosen.write.parquet(kept)
    keys = spark.read.parquet(kept)
    files = keys.groupBy("__file").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy("__file").collect()  # a row per file of the table
    known = [r for r in files if r.lo is not None]
    if not known:
        return rows.select(key, *columns).limit(0)
    held = spark.read.schema(rows.schema).parquet(*(r["__file"] for r in known))
    near = held.where(F.col(key).between(min(r.lo for r in known), max(r.hi for r in known)))
    return near.select(key, *columns).join(keys.select(key), key, "left_semi")


def with_split(rows: DataFrame, day: str, train: float, val: float) -> DataFrame:
    """rows with split: the first days are train, the next val, the rest sealed.  The window runs over one row per day."""
    days = rows.select(day).distinct()
    ranked = days.select(day, F.row_number().over(Window.orderBy(day)).alias("__i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("__n"))
    label = F.when(F.col("__i") <= F.col("__n") * train, "train").when(F.col("__i") <= F.col("__n") * val, "val").otherwise("sealed")
    return rows.join(ranked.select(day, label.alias("split")), day)
