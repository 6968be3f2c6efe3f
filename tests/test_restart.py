"""Builds and streams that are stopped, run again or carried over batches; scans that open few files; isotonic fits by bucket."""

import random

import pytest
from pyspark.sql import functions as F

from eventide.operators import learn as L
from eventide.sources import tape as IO
from eventide.streaming import live as R

DAY = 86_400_000_000


def days(spark, n=9, each=4):
    return spark.range(n * each).select(F.floor(F.col("id") / each).alias("day"), F.col("id").alias("x"))


def counts(spark, path):
    return sorted((r.day, r["count"]) for r in spark.read.parquet(path).groupBy("day").count().collect())


def test_build_is_taken_up_after_a_crash(spark, monkeypatch):
    path, rows, calls, real = IO.scratch(spark, "crash"), days(spark), [], IO.finish

    def dies(*args):
        calls.append(args[-1])
        if len(calls) == 2:
            raise RuntimeError("killed after its write, before the manifest")
        real(*args)

    monkeypatch.setattr(IO, "finish", dies)
    with pytest.raises(RuntimeError):
        IO.build_missing(rows, path, "day", per_commit=2)
    monkeypatch.setattr(IO, "finish", real)
    assert sorted(r[0] for r in IO.finished(spark, path, rows.select("day").schema).collect()) == [0, 1]
    # what a broken run left of a partition is replaced, not added to
    rows.where("day = 5").limit(1).write.mode("append").partitionBy("day").parquet(path)
    IO.build_missing(rows, path, "day", per_commit=2)
    whole = [(d, 4) for d in range(9)]
    assert counts(spark, path) == whole
    IO.build_missing(days(spark, 9, 7), path, "day")  # finished partitions stay as they are
    assert counts(spark, path) == whole
    IO.build_missing(days(spark, 10), path, "day")
    assert counts(spark, path) == [*whole, (9, 4)]


def test_batch_written_again_replaces_itself(spark):
    sink = IO.scratch(spark, "replayed")
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "event_type string")
    for number, batch in ((0, a), (1, a), (1, a), (0, a)):
        R.count_batch(batch, number, sink)
    assert {r.event_type: r.n for r in spark.read.parquet(sink).groupBy("event_type").agg(F.sum("count").alias("n")).collect()} == {"x": 4, "y": 2}


def test_campaign_after_its_checkpoint_lost_a_commit(spark):
    """The last commit of the checkpoint is taken away, as by a crash: the batch runs again and the sink stays right."""
    source, sink, check = (IO.scratch(spark, x) for x in ("source", "sink", "check"))
    rows = spark.createDataFrame([("x",), ("y",), ("x",)], "event_type string")
    rows.write.parquet(source)
    R.daily_campaign(spark, source, rows.schema, sink, check)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{check}/commits/0")
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, False)
    R.daily_campaign(spark, source, rows.schema, sink, check)
    assert {r.event_type: r["count"] for r in spark.read.parquet(sink).collect()} == {"x": 2, "y": 1}


def in_batches(spark, batches):
    # hours after 1970, which is where watermarks start
    rows = [(k, t + DAY, v, b) for b, batch in enumerate(batches) for k, t, v in batch]
    df = spark.createDataFrame(rows, "user_id long, t long, value double, b long").withColumn("ts", F.timestamp_micros("t"))
    return R.arrivals(df, F.col("b"), len(batches))


def test_level_is_carried_over_batches_and_expires(spark):
    s = 1_000_000
    stream = in_batches(spark, [
        [(1, 0, 5.0), (2, 0, 1.0), (1, s, 5.0)],
        [(1, 2 * s, 5.0), (2, 3 * s, 2.0)],  # 1's level was seen in an earlier batch
        [(3, 60 * s, 0.0)],  # the watermark goes on: 1 and 2 are forgotten
        [(1, 61 * s, 5.0), (2, 62 * s, 2.0)],
        [(1, 66 * s, 5.0), (3, 75 * s, 0.0)],  # 3 comes back after more than ten seconds, before any timer of its own
    ])
    out = R.drain(R.changes_only(stream, "user_id", "ts", F.col("value"), 10 * s))
    assert sorted((r.key, (r.t - DAY) // s, r.level) for r in out.collect()) == [(1, 0, 5.0), (1, 61, 5.0), (2, 0, 1.0), (2, 3, 2.0), (2, 62, 2.0), (3, 60, 0.0), (3, 75, 0.0)]


def test_watchdog_and_a_late_revival(spark):
    s = 1_000_000
    stream = in_batches(spark, [
        [(1, 0, 0.0), (2, 0, 0.0), (3, 0, 0.0)],
        [(9, 14 * s, 0.0)],  # 1, 2 and 3 have been silent for over ten seconds, but rows may still be five seconds late
        [(2, 9 * s, 0.0)],  # late, in time: 2 was not silent until now
        [(9, 16 * s, 0.0), (3, 16 * s, 0.0)],  # the watermark passes 11: 1's and 3's silence is told, 3's although it is back
        [(9, 30 * s, 0.0)],
    ])
    out = R.drain(R.silences(stream, "user_id", "ts", 10 * s, "5 seconds"))
    # 9 is never silent for long; what comes after the last watermark is not told
    assert sorted((r.key, (r.silent_since - DAY) // s) for r in out.collect()) == [(1, 0), (2, 9), (3, 0)]


def test_late_materialised_scan_opens_few_files(spark):
    path = IO.scratch(spark, "wide")
    rows = spark.range(4000).select("id", (F.col("id") / 1000).cast("int").alias("kind"), F.array_repeat(F.col("id").cast("double"), 64).alias("wide"))
    rows.repartitionByRange(20, "id").sortWithinPartitions("id").write.parquet(path)
    few = IO.late_materialised(spark, path, "id", F.col("id").isin(5, 2001, 2003), ["wide"])
    assert sorted((r.id, r.wide[0]) for r in few.collect()) == [(5, 5.0), (2001, 2001.0), (2003, 2003.0)]
    half = IO.late_materialised(spark, path, "id", F.col("kind") < 2, ["wide"])
    opened = [len([f for f in df.inputFiles() if "/wide-" in f]) for df in (few, half)]
    assert opened[0] <= 2 and 10 <= opened[1] <= 11 and half.count() == 2000
    assert IO.late_materialised(spark, path, "id", F.col("kind") > 9, ["wide"]).count() == 0


def plain_isotonic(points):
    """(score, y) to value at each score: means that rise, by pooling."""
    of = {}
    for p, y in points:
        n, s = of.get(p, (0, 0.0))
        of[p] = n + 1, s + y
    scores = sorted(of)
    out = {}
    for i, p in enumerate(scores):
        out[p] = max(min(sum(of[q][1] for q in scores[a : b + 1]) / sum(of[q][0] for q in scores[a : b + 1]) for b in range(i, len(scores))) for a in range(i + 1))
    return out


def test_isotonic_by_bucket(spark):
    rng = random.Random(8)
    rows = [(k, rng.randint(0, 25) / 10, float(rng.random() < 0.3 + 0.1 * i)) for i, k in enumerate([None, "a", "b", "c"]) for _ in range(120)]
    rows += [("a", None, 1.0), ("b", 0.5, None), ("d", 0.3, None), ("one", 0.7, 1.0)]
    df = spark.createDataFrame(rows, "k string, p double, y double")
    got = {(r.k, r.p): r.calibrated for r in L.isotonic(df, "p", "y", ["k"]).collect()}
    for k in (None, "a", "b", "c", "one"):
        want = plain_isotonic([(p, y) for kk, p, y in rows if kk == k and p is not None and y is not None])
        for p, v in want.items():
            assert got[k, p] == pytest.approx(v, abs=1e-12)
    assert got["a", None] is None and got["d", 0.3] is None
    fit = spark.createDataFrame([("a", 0.2, 0.0), ("a", 0.4, 1.0)], "k string, p double, y double")
    asked = spark.createDataFrame([("a", 0.1), ("a", 0.25), ("a", 0.9)], "k string, p double")
    assert [r.calibrated for r in L.isotonic(asked, "p", "y", ["k"], fit).orderBy("p").collect()] == pytest.approx([0.0, 0.25, 1.0])
    assert L.isotonic(df.limit(0), "p", "y", ["k"]).count() == 0
    # cut into many ranges, the steps are the same
    for ranges in (1, 13):
        steps = L.isotonic_steps(df.where("k = 'b'"), ["k"], "p", "y", ranges).orderBy("lo").collect()
        assert [s.v for s in steps] == sorted(s.v for s in steps) and sum(s.n for s in steps) == 120
