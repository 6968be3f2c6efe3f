"""Hard negatives against every pair, on vectors with ties, copies, nulls and clusters, and against SQL."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import hard_negatives as H
from eventide.llm.oracle import ORACLE
from eventide.llm.queries import op11_hard_negatives


def plain(rows, anchors, positives=5, negatives=5):
    """rows: (id, label, vector); anchors: places in rows."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    last = lambda i: (i is None, i)
    out = []
    for a in anchors:
        ida, la, va = rows[a]
        scored = [(dot(va, v), i, lab) for i, lab, v in rows if i != ida and lab is not None and v is not None]
        first = sorted(((s, i) for s, i, lab in scored if lab == la), key=lambda x: (-x[0], last(x[1])))[:positives]
        for ps, pid in first:
            band = sorted(((s, i) for s, i, lab in scored if lab != la and 80 * ps <= 100 * s <= 100 * ps), key=lambda x: (-x[0], last(x[1])))[:negatives]
            out += [(ida, pid, k + 1, i, ps, s) for k, (s, i) in enumerate(band)]
    return Counter(out)


COLS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def found(df):
    return Counter(tuple(r[c] for c in COLS) for r in df.collect())


@pytest.mark.parametrize("seed,dims,centres", [(1, 8, 64), (2, 3, 2), (3, 1, 64)])
def test_all_pairs(spark, monkeypatch, seed, dims, centres):
    monkeypatch.setattr(H, "CENTRES", centres)
    monkeypatch.setattr(H, "BLOCK", 7)
    rng = np.random.default_rng(seed)
    middles = rng.integers(-40, 40, (6, dims))
    rows = []
    for i in range(900):
        m = int(rng.integers(6))
        v = middles[m] + rng.integers(-9, 9, dims) if i % 3 else middles[m]  # a third are copies: ties
        rows.append((i, int(rng.integers(3)) if i % 5 else m, [int(x) for x in v]))
    rows += [(None, 1, [3] * dims), (1000, 2, [0] * dims), (1001, None, [1] * dims), (1002, 1, None), (1003, 0, [-5] * dims), (1010, 1, [0] * dims), (1020, 0, [7] * (dims - 1))]
    rows += rows[:40]  # repeated rows, anchors among them
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>").withColumn("rank", F.lit("clash")).repartition(3)
    anchors = [k for k, (i, lab, v) in enumerate(rows) if i is not None and i % 10 == 0 and lab is not None and v is not None]
    assert found(H.hard_negatives(df, F.col("vec_id") % 10 == 0)) == plain(rows, anchors)


def test_edges(spark):
    df = spark.createDataFrame([(0, 1, [1, 2]), (1, 1, None), (2, None, [1, 1])], "vec_id long, label int, vector array<long>")
    for rows in (df, df.limit(0), df.where("vec_id > 0"), df.withColumn("vector", F.array().cast("array<long>"))):
        out = H.hard_negatives(rows, F.col("vec_id") % 100 == 0)
        assert out.columns == COLS and out.count() == 0
    raw = spark.createDataFrame([(1, [1.0, None], 1), (2, [float("nan")], 1), (3, [float("inf")], 1), (4, None, 1), (5, [1.0], None), (6, [0.5, -0.001], 1)], "vec_id long, embedding array<float>, label int")
    kept = H.usable(raw).select("vec_id", H.quantised("embedding", 256).alias("q")).collect()
    assert [(r.vec_id, r.q) for r in kept] == [(6, [128, -1])]


def test_walks_end_early():
    """On clustered rows a walk is certified before its list ends, and finds what the whole list holds."""
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(40, 16)) * 300
    rows = np.rint(middles[rng.integers(40, size=20_000)] + rng.normal(size=(20_000, 16)) * 20)
    members = np.rint(middles[7] + rng.normal(size=(20, 16)) * 20)
    centre = (middles[7] / np.linalg.norm(middles[7]))[None, :]
    length = np.linalg.norm(rows, axis=1)
    opening = float(np.arccos(H.cosines(members, np.linalg.norm(members, axis=1), centre)).max())
    reach = H.bounds(np.arccos(H.cosines(rows, length, centre))[:, 0], length, opening)
    best, place = H.Best(20, 1, 5), np.arange(len(rows))
    taken = H.walk(members, reach, rows, place, np.argsort(-reach, kind="stable"), best, lambda m, s, r: iter([np.ones(s.shape, bool)]), None, True)
    scores = (members @ rows.T).astype(np.int64)
    assert (best.score == -np.sort(-scores, axis=1)[:, :5]).all()
    assert taken < 0.3 * scores.size


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    rel = con.sql(ORACLE["op11_hard_negatives"])
    assert rel.columns == COLS
    assert found(op11_hard_negatives(spark, sf)) == Counter(rel.fetchall())
