"""What turns up on larger tables only: rare values, sums on a bound, keys by the thousand."""

import duckdb
from pyspark.sql import Row
from pyspark.sql import functions as F

from eventide.operators import accounts as A
from eventide.operators import grid as G
from eventide.plans.all_queries import ORACLE, QUERIES
from eventide.streaming import live as R


def written_events(folder, rows):
    """events.parquet of (user_id, microseconds in 2024, event_type, value, k)."""
    con = duckdb.connect()
    con.sql("CREATE TABLE e (event_id BIGINT, user_id BIGINT, us BIGINT, event_type VARCHAR, value DOUBLE, k BIGINT)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?, ?)", [(i, *r) for i, r in enumerate(rows)])
    path = f"{folder}/events.parquet"
    con.sql(f"""COPY (SELECT event_id, TIMESTAMP '2024-01-01' + to_microseconds(us) AS ts, user_id, event_type, value, '{{"k": ' || k || '}}' AS props FROM e) TO '{path}' (FORMAT parquet)""")
    return str(folder)


def agrees(spark, name, folder):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    rel = con.sql(ORACLE[name])
    got = sorted(map(str, (tuple(r) for r in QUERIES[name](spark, folder).select(*rel.columns).collect())))
    assert got == sorted(map(str, rel.fetchall())) and got
    return got


def test_interpolation_ends_with_its_curve(spark, tmp_path):
    folder = written_events(tmp_path, [(1, 1, "purchase", 599.99, 1), (1, 2, "purchase", 600.0, 1), (1, 3, "purchase", 712.5, 1), (1, 4, "purchase", 0.0, 1)])
    assert len(agrees(spark, "f14_linear_interpolation", folder)) == 2


def test_sums_that_reach_a_bound_exactly(spark):
    # 0.7 + 0.1 is 0.7999999999999999 in doubles
    df = spark.createDataFrame([("a", 0, 1, -0.7), ("a", 0, 2, -0.1), ("b", 0, 1, -0.7), ("b", 0, 2, -0.09)], "k string, day int, t int, pnl double")
    status = lambda fall, loss: {(r.k, r.t): r.status for r in A.risk_path(df, "k", "day", ["t"], "pnl", fall, 99, loss, worst_t=-99.0).collect()}
    assert status(0.8, 99.0) == {("a", 1): "OK", ("a", 2): "HALTED", ("b", 1): "OK", ("b", 2): "OK"}
    assert status(99.0, 0.8) == {("a", 1): "OK", ("a", 2): "PAUSED", ("b", 1): "OK", ("b", 2): "OK"}


def test_few_thresholds_need_no_python_worker(spark, monkeypatch):
    values = [None, float("nan"), float("inf"), -0.0, 0.0, 0.5, 1.0, 1.5, 2.0, 9.0]
    df = spark.createDataFrame([(v, float(i - 4), "all") for i, v in enumerate(values)], "a double, p double, split string")
    rules = spark.createDataFrame([(f"{op}{t}", "a", op, t, "up") for op in (">", ">=", "<", "<=") for t in (0.0, 1.0, 1.5, 7.0)], "cid string, feature string, op string, thr double, side string")
    asked = []
    monkeypatch.setattr(F, "pandas_udf", lambda *a, **k: asked.append(a) or udf(*a, **k))
    few = sorted(map(str, scored(df, rules)))
    assert not asked
    monkeypatch.setattr(G, "FEW_CUTS", 0)
    many = sorted(map(str, scored(df, rules)))
    assert asked and few == many and few


def test_watchdog_calls_no_python_per_account(spark, tmp_path):
    hour = 3_600_000_000
    rows = [(u, (u % 7 + step * (u % 5 + 20)) * hour + u, "view", 1.0, 1) for u in range(60) for step in range(12) if (u + step) % 6]
    folder = written_events(tmp_path, [*rows, (1, 24 * hour + 1, "view", 1.0, 1), (1, 48 * hour + 1, "view", 1.0, 1), (1, 72 * hour + 2, "view", 1.0, 1), (99, 400 * hour, "view", 1.0, 1)])
    events = spark.read.parquet(f"{folder}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    plan = R.silences(R.replay(events), "user_id", "ts", 24 * hour, "1 hour")._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and "Pandas" not in plan
    agrees(spark, "r10_watchdog", folder)


class Held:
    """A key's state and timers, with the calls that were made to them."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


def test_levels_make_few_state_calls_and_no_frames():
    held, levels = Held(), R.Levels(10_000)
    levels.init(held)
    give = lambda *rows: [tuple(r) for r in levels.handleInputRows((7,), iter([Row(key=7, t=t, level=v) for t, v in rows]), None)]
    assert give((3_000, 1.0), (1_000, 1.0), (2_000, 2.0)) == [(7, 1_000, 1.0), (7, 2_000, 2.0), (7, 3_000, 1.0)]
    assert give((4_000, 1.0), (15_000, 1.0), (16_000, None), (17_000, None)) == [(7, 15_000, 1.0), (7, 16_000, None), (7, 17_000, None)]
    assert held.calls == 7 and held.timers == {28} and held.value == (None, 17_000)


udf = F.pandas_udf


def scored(df, rules):
    return G.score_configs(df, rules, ["split"], {"up": F.col("p")}).collect()
