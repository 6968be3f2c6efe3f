"""Streaming operators: bounded retention, bucketed values, de-duplication, outcomes, settlement joins."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.tape import scratch


def replay(rows: DataFrame, batches: int = 4, untimed: bool = False) -> DataFrame:
    """A stream of a table's rows in micro-batches of equal spans of time, in time order, so that state is carried over.
    Rows without a time are left out; if ``untimed``, they come with the last batch."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = rows.agg(F.min(micros).alias("lo"), F.max(micros).alias("hi")).first()  # two numbers
    lo, hi = span.lo or 0, span.hi or 0
    batch = F.floor((micros - lo) / (hi - lo + 1) * batches)
    return arrivals(rows, F.coalesce(batch, F.lit(batches - 1)) if untimed else batch, batches)


def arrivals(rows: DataFrame, batch: Column, batches: int) -> DataFrame:
    """A stream of rows in the order in which they became available: a file, and a micro-batch, per number of ``batch``."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "arrivals")
    numbered = rows.withColumn("__batch", batch)
    for b in range(batches):
        numbered.where(F.col("__batch") == b).drop("__batch").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(path)


def counts_in_time(stream: DataFrame, ts: str, width: str, late: str) -> DataFrame:
    """(start, n) of each window; a row is dropped if its window was over before the watermark when it came."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over everything that is there and gives the sink as a table; run again on the same checkpoint it
    takes only what is new."""
    spark = stream.sparkSession
    out = scratch(spark, "sink")
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out)
    else:
        writer = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out))
    query = writer.outputMode(mode).option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def retained_counts(stream: DataFrame, by: list[str], ts: str, keep: str) -> DataFrame:
    """(by…, start, n) of each stretch of ``keep``, given once it is over; nothing older than that is held as state."""
    return stream.withWatermark(ts, keep).groupBy(*by, F.window(ts, keep).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("start"), "n")


def bucketed_last(stream: DataFrame, by: list[str], ts: str, width: str, value: str, late: str) -> DataFrame:
    """The last value of each key and tumbling window; a window is given once the watermark has passed it."""
    return stream.withWatermark(ts, late).groupBy(*by, F.window(ts, width).alias("w")).agg(F.max_by(value, ts).alias("last")).select(*by, F.col("w.start").alias("start"), "last")


def rolling_sigma(stream: DataFrame, ts: str, width: str, slide: str, value: str, late: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(value).alias("sigma")).select(F.col("w.end").alias("end"), "n", "sigma")


def outcomes(stream: DataFrame, ts: str, width: str, value: str, late: str) -> DataFrame:
    """Open, close and direction of each tumbling window."""
    o, c = F.min_by(value, ts), F.max_by(value, ts)
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w")).agg(o.alias("open"), c.alias("close")).select(F.col("w.start").alias("start"), "open", "close", (F.col("close") >= F.col("open")).alias("up"))


def state_store(spark: SparkSession) -> None:
    """State of one key is read and written by itself, and timers are kept, by the store that keeps state on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Levels(StatefulProcessor):
    """Gives the rows whose level differs from the one before of their key; a level is forgotten ``keep_us`` after it was last
    seen, by the row's own time if the next row comes later than that, and by a timer where none comes."""

    def __init__(self, keep_us: int):
        self.keep = keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "level double, t long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # a micro-batch's rows of one key: what a key brings between two triggers
        new = sorted(((r["t"], r["level"]) for r in rows), key=lambda r: r[0])
        held = self.last.get()
        level, seen = held or (None, None)
        for t, now in new:
            if level is None or now != level or t - seen > self.keep:
                yield Row(key=key[0], t=t, level=now)
            level, seen = now, t
        if held is None or seen >= held[1]:
            if held is not None:
                self.handle.deleteTimer(self._over(held[1]))
            self.last.update((level, seen))
            self.handle.registerTimer(self._over(seen))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.last.get()
        if held is not None and self._over(held[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def _over(self, t: int) -> int:
        return (t + self.keep) // 1000 + 1

    def close(self) -> None:
        pass


def changes_only(stream: DataFrame, key: str, ts: str, value: Column, keep_us: int, late: str = "0 seconds") -> DataFrame:
    """(key, t, level) of rows whose ``value`` differs from the row before of their key, or that come more than ``keep_us`` after
    it.  State is one level per key seen within ``keep_us`` of the watermark, however many keys there ever were; a row
    that comes in a later batch than a newer one is compared with what its key held last."""
    state_store(stream.sparkSession)
    shaped = stream.withWatermark(ts, late).select(F.col(key).cast("long").alias("key"), F.unix_micros(ts).alias("t"), value.cast("double").alias("level"), F.col(ts).alias("__ts"))
    return shaped.groupBy("key").transformWithState(Levels(keep_us), "key long, t long, level double", "append", "EventTime")


def silences(stream: DataFrame, key: str, ts: str, keep_us: int, late: str) -> DataFrame:
    """(key, silent_since): an alert, on the stream, for every row after which its key gives none for longer than ``keep_us``; it
    comes once the watermark (``late`` and a millisecond behind the newest row of any key) has passed that time.

    A key's rows no further apart than that are one session, which ends when its silence is told.  State is the open
    sessions: rows that come late, but before that, lengthen or join them, and so call a pending alert off."""
    state_store(stream.sparkSession)
    gap = keep_us + 1  # a session takes rows that are nearer than its gap
    sessions = stream.withWatermark(ts, f"{late} 1 millisecond").groupBy(F.col(key).cast("long").alias("key"), F.session_window(ts, f"{gap} microseconds").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return sessions.select("key", (F.unix_micros("s.end") - gap).alias("silent_since"))


def settle(decisions: DataFrame, results: DataFrame, key: str, ts: str, within: str, late: str) -> DataFrame:
    """Stream-stream join of decisions with the results that follow within the bound; state is kept no longer than that."""
    d = decisions.withWatermark(ts, late).select(F.col(key).alias("d_key"), F.col(ts).alias("d_ts"), F.col("event_id").alias("d_id"))
    r = results.withWatermark(ts, late).select(F.col(key).alias("r_key"), F.col(ts).alias("r_ts"), F.col("event_id").alias("r_id"))
    return d.join(r, F.expr(f"d_key = r_key AND r_ts > d_ts AND r_ts <= d_ts + INTERVAL {within}")).select("d_id", "r_id")


def count_batch(batch: DataFrame, number: int, sink: str) -> None:
    """A batch's counts by event type, in the partition of its number: written again, they replace themselves."""
    counted = batch.groupBy("event_type").count().withColumn("batch", F.lit(number))
    counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sink)


def daily_campaign(spark: SparkSession, source: str, schema, sink: str, checkpoint: str) -> None:
    """Processes the files that are new since the last call.  A batch that is run again, as after a crash between its write
    and its commit, leaves the sink as it was."""
    rows = spark.readStream.schema(schema).parquet(source)
    done = rows.writeStream.foreachBatch(lambda batch, number: count_batch(batch, number, sink))
    done.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
