"""Streaming R1-R12 and models L1-L11.  Streams replay the events table and run until they have seen all of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import accounts as A
from ..operators import learn as L
from ..streaming import live as R
from .data import DAY, HOUR, events, sql, table, trades
from .q_measure import CALIBRATION, PNL, decisions, pnl
from .registry import query


def stream(spark, sf, kind: str | None = None, untimed: bool = False):
    rows = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    replayed = R.replay(rows, untimed=untimed)
    return replayed.where(F.col("event_type") == kind) if kind else replayed


# Windows that end before the last event less the allowed lateness have been given when the stream has run dry.


@query(sql("SELECT event_type, t // 400000000 * 400000000 AS start_us, count(*) AS n FROM ev GROUP BY 1, 2 HAVING start_us + 400000000 <= (SELECT max(t) - 400000000 FROM ev)"))
def r1_tick_ingestion(spark, sf):
    out = R.drain(R.retained_counts(stream(spark, sf), ["event_type"], "ts", "400 seconds"))
    return out.select("event_type", F.unix_micros("start").alias("start_us"), "n")


@query(sql("SELECT user_id, t // (6 * {H}) * 6 * {H} AS start_us, max_by(value, t) AS last FROM ev WHERE event_type = 'view' GROUP BY 1, 2 HAVING start_us + 6 * {H} <= (SELECT max(t) - {H} FROM ev WHERE event_type = 'view')"))
def r2_bucketed_last(spark, sf):
    out = R.drain(R.bucketed_last(stream(spark, sf, "view"), ["user_id"], "ts", "6 hours", "value", "1 hour"))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "last")


@query(sql("WITH w AS (SELECT t // (6 * {H}) * 6 * {H} + j * 6 * {H} + 6 * {H} AS end_us, value FROM ev, (VALUES (0), (1), (2), (3)) v(j) WHERE event_type = 'click') SELECT end_us, count(*) AS n, round(stddev_pop(value), 5) AS sigma FROM w GROUP BY 1 HAVING end_us <= (SELECT max(t) - {H} FROM ev WHERE event_type = 'click')"))
def r3_rolling_sigma(spark, sf):
    out = R.drain(R.rolling_sigma(stream(spark, sf, "click"), "ts", "24 hours", "6 hours", "value", "1 hour"))
    return out.select(F.unix_micros("end").alias("end_us"), "n", S.rounded("sigma", 5).alias("sigma"))


@query(sql("SELECT t // {D} * {D} AS start_us, min_by(value, t) AS open, max_by(value, t) AS close, max_by(value, t) >= min_by(value, t) AS up FROM ev WHERE event_type = 'signup' GROUP BY 1 HAVING start_us + {D} <= (SELECT max(t) - {H} FROM ev WHERE event_type = 'signup')"))
def r4_window_outcomes(spark, sf):
    return R.drain(R.outcomes(stream(spark, sf, "signup"), "ts", "1 day", "value", "1 hour")).select(F.unix_micros("start").alias("start_us"), "open", "close", "up")


@query(sql("WITH l AS (SELECT user_id AS key, t, floor(value / 50) AS level, lag(floor(value / 50)) OVER w AS before, t - lag(t) OVER w AS gap FROM ev WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT key, t, level FROM l WHERE before IS NULL OR level <> before OR gap > 3 * {D}"))
def r5_change_dedup(spark, sf):
    return R.drain(R.changes_only(stream(spark, sf, "view"), "user_id", "ts", F.floor(F.col("value") / 50), 3 * DAY))


#: Every twentieth event becomes available two weeks after it happened; arrivals are cut into ten batches of equal spans.
#: Spark judges lateness by the watermark of the batch before, so a batch's bound comes from what lay two batches back.
ARRIVED = """a AS (SELECT t, t + CASE WHEN event_id % 20 = 0 THEN 14 * {D} ELSE 0 END AS came FROM ev), g AS (SELECT min(came) AS lo, max(came) AS hi FROM a), b AS (SELECT t, (came - lo) * 10 // (hi - lo + 1) AS batch FROM a, g),
m AS (SELECT batch, max(t) AS top FROM b GROUP BY 1), l AS (SELECT b.batch, max(m.top) - {D} AS bound FROM (SELECT DISTINCT batch FROM b) b LEFT JOIN m ON m.batch <= b.batch - 2 GROUP BY 1)"""


@query(sql("WITH " + ARRIVED + " SELECT t // {D} * {D} AS start_us, count(*) AS n FROM b JOIN l USING (batch) WHERE bound IS NULL OR t // {D} * {D} + {D} > bound GROUP BY 1 HAVING start_us + {D} <= (SELECT max(t) - {D} FROM ev)"))
def r6_late_rows(spark, sf):
    """Rows that become available after their day was closed are dropped by the watermark."""
    rows = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.withColumn("came", F.unix_micros("ts") + F.when(F.col("event_id") % 20 == 0, 14 * DAY).otherwise(0))
    span = rows.agg(F.min("came").alias("lo"), F.max("came").alias("hi")).first()  # two numbers
    batch = F.floor((F.col("came") - F.lit(span.lo or 0)) * 10 / F.lit((span.hi or 0) - (span.lo or 0) + 1))
    out = R.drain(R.counts_in_time(R.arrivals(rows, batch, 10), "ts", "1 day", "1 day"))
    return out.select(F.unix_micros("start").alias("start_us"), "n")


@query(sql("SELECT d.event_id AS d_id, r.event_id AS r_id FROM ev d JOIN ev r ON d.user_id = r.user_id AND d.event_type = 'view' AND r.event_type = 'purchase' AND r.t > d.t AND r.t <= d.t + 6 * {H}"))
def r7_settlement_join(spark, sf):
    return R.drain(R.settle(stream(spark, sf, "view"), stream(spark, sf, "purchase"), "user_id", "ts", "6 HOURS", "1 hour"))


def accounts(rows):
    return rows.select(F.col("user_id").alias("account"), "event_id", "t", F.floor(F.col("t") / DAY).alias("day"), (F.col("value") - 60).alias("pnl"))


RISK = """WITH x AS (SELECT user_id AS account, event_id, t, t // {D} AS day, value - 60 AS pnl, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS place FROM ev),
e AS (SELECT *, sum(pnl) OVER w AS equity, max(CASE WHEN pnl >= 0 THEN place END) OVER w AS gain, sum(pnl) OVER (PARTITION BY account, day ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS day_pnl, count(*) OVER r AS n, avg(pnl) OVER r AS m, stddev_samp(pnl) OVER r AS sd
FROM x WINDOW w AS (PARTITION BY account ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), r AS (PARTITION BY account ORDER BY t, event_id ROWS 39 PRECEDING)),
d AS (SELECT *, greatest(max(equity) OVER (PARTITION BY account ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 0) - equity AS drawdown, place - coalesce(gain, 0) AS loss_run, CASE WHEN n >= 25 AND sd > 0 THEN m / (sd / sqrt(n)) END AS decay_t FROM e),
s AS (SELECT *, max(drawdown >= 350 OR loss_run >= 6 OR coalesce(decay_t <= -1.5, false)) OVER (PARTITION BY account ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS halted, min(day_pnl) OVER (PARTITION BY account, day ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) <= -100 AS paused FROM d)
"""


@query(sql(RISK + "SELECT account, count(*) AS n, round(sum(pnl), 4) AS equity, round(max(drawdown), 4) AS drawdown, max(loss_run) AS loss_run, round(min(decay_t), 5) AS worst_t, min(CASE WHEN halted THEN t END) AS halted_at, count(*) FILTER (WHERE paused AND NOT halted) AS paused FROM s GROUP BY 1"))
def r8_account_risk_state(spark, sf):
    """The stream's trades are appended to a table; an account's state is windows over it, up to any trade."""
    live = R.drain(accounts(stream(spark, sf, untimed=True).withColumn("t", F.unix_micros("ts"))))
    path = A.risk_path(live, "account", "day", ["t", "event_id"], "pnl", 350.0, 6, 100.0, recent=40, least=25, missing=None)
    halted = F.col("status") == "HALTED"
    return path.groupBy("account").agg(
        F.count(F.lit(1)).alias("n"), S.rounded(F.sum("pnl"), 4).alias("equity"), S.rounded(F.max("drawdown"), 4).alias("drawdown"), F.max("loss_run").cast("long").alias("loss_run"), S.rounded(F.min("decay_t"), 5).alias("worst_t"),
        F.min(F.when(halted, F.col("t"))).alias("halted_at"), F.count_if(F.col("status") == "PAUSED").alias("paused"),
    )


@query(sql("WITH x AS (SELECT user_id AS account, event_id, t, t // {D} // 7 AS week, value - 60 AS pnl, avg(CASE WHEN value > 60 THEN 1.0 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS 9 PRECEDING) AS rate FROM ev), w AS (SELECT account, week, count(*) AS n, sum(pnl) AS pnl, max_by(rate, (t, event_id)) AS rate FROM x GROUP BY 1, 2) SELECT account, week, n, round(pnl, 4) AS pnl, round(rate, 6) AS rate, CASE WHEN pnl < 0 THEN 'down' WHEN pnl > 0 AND n >= 3 AND rate >= 0.5 THEN 'up' ELSE 'stay' END AS verdict FROM w"))
def r9_weekly_review(spark, sf):
    w = A.weekly_review(accounts(events(spark, sf)), "account", "day", ["t", "event_id"], "pnl", 3, 0.5, recent=10)
    return w.select("account", "week", "n", S.rounded("pnl", 4).alias("pnl"), S.rounded("rate", 6).alias("rate"), "verdict")


@query(sql("SELECT user_id, count(*) AS gaps FROM (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM ev) WHERE gap > {D} GROUP BY 1"))
def r10_inactivity_report(spark, sf):
    """Session windows: an account's sessions less one are its gaps of more than a day."""
    sessions = events(spark, sf).select("user_id", F.timestamp_micros("t").alias("ts")).groupBy("user_id", F.session_window("ts", "86400000001 microseconds")).agg(F.count(F.lit(1)).alias("n"))
    return sessions.groupBy("user_id").agg((F.count(F.lit(1)) - 1).alias("gaps")).where("gaps > 0")


@query(sql("WITH g AS (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS next FROM ev) SELECT user_id, t AS silent_since FROM g WHERE CASE WHEN next IS NULL THEN t + {D} < (SELECT max(t) - {H} - 1000 FROM ev) ELSE next - t > {D} AND t + {D} < (SELECT max(t) - {H} - 1000 FROM ev) END"))
def r10_watchdog(spark, sf):
    """Alerts on the stream when an account has been silent for a day."""
    return R.drain(R.silences(stream(spark, sf), "user_id", "ts", DAY, "1 hour")).withColumnRenamed("key", "user_id")


@query(sql("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY 1"))
def r11_running_status(spark, sf):
    return R.drain(stream(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), S.rounded(F.sum("value"), 4).alias("total")), "complete")


@query(sql("SELECT event_type, count(*) AS n FROM ev GROUP BY 1"))
def r12_daily_campaign(spark, sf):
    """Two calls over a growing folder: the second takes only the files that the first did not see."""
    rows = events(spark, sf)
    source, sink, check = (R.scratch(spark, x) for x in ("days", "campaign", "checkpoint"))
    for part in (rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")):
        part.write.mode("append").parquet(source)
        R.daily_campaign(spark, source, rows.schema, sink, check)
        R.daily_campaign(spark, source, rows.schema, sink, check)  # nothing is new
    return spark.read.parquet(sink).groupBy("event_type").agg(F.sum("count").alias("n"))


# ---- models


@query(sql("WITH d AS (SELECT DISTINCT t // {D} AS day FROM ev), f AS (SELECT day, CAST((row_number() OVER (ORDER BY day) - 1) * 6 // count(*) OVER () AS BIGINT) AS fold FROM d) SELECT fold, min(day) AS first_day, count(*) AS days, min(day) - 1 AS fit_before FROM f GROUP BY 1"))
def l1_walk_forward_folds(spark, sf):
    f = L.date_folds(events(spark, sf).withColumn("day", F.floor(F.col("t") / DAY)), "day", 6)
    return f.groupBy("fold").agg(F.min("day").alias("first_day"), F.count(F.lit(1)).alias("days"), (F.min("day") - 1).alias("fit_before"))


def labelled(spark, sf):
    rows = trades(spark, sf).select("event_id", F.floor(F.col("t") / DAY).alias("day"), F.col("size").cast("double").alias("x1"), (F.col("t") % DAY / HOUR).alias("x2"), F.col("user_id").cast("double").alias("x3"), "price")
    return rows.withColumn("y", (F.col("price") > 60).cast("double"))


@query()
def l2_l4_walk_forward_logistic(spark, sf):
    return L.walk_forward(labelled(spark, sf), ["x1", "x2", "x3"], "y", "day", 4, 1, L.logistic)


@query()
def l3_gradient_boosting(spark, sf):
    return L.walk_forward(labelled(spark, sf), ["x1", "x2", "x3"], "y", "day", 2, 1, L.boosted)


@query()
def l5_isotonic_out_of_fold(spark, sf):
    return L.isotonic(L.walk_forward(labelled(spark, sf), ["x1", "x2", "x3"], "y", "day", 3, 1, L.logistic), "p", "y")


#: The isotonic value at a score is the largest, over starts at or before it, of the smallest mean up to an end at or after it.
@query(sql("""WITH s AS (SELECT event_type, k, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE value > 60) AS DOUBLE) AS y FROM ev WHERE k IS NOT NULL GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER w AS cn, sum(y) OVER w AS cy FROM s WINDOW w AS (PARTITION BY event_type ORDER BY k)),
m AS (SELECT i.event_type, i.k, a.k AS start, min((b.cy - a.cy + a.y) / (b.cn - a.cn + a.n)) AS least FROM c i JOIN c a ON a.event_type = i.event_type AND a.k <= i.k JOIN c b ON b.event_type = i.event_type AND b.k >= i.k GROUP BY 1, 2, 3), f AS (SELECT event_type, k, max(least) AS v FROM m GROUP BY 1, 2)
SELECT event_id, round(v, 6) AS calibrated FROM ev LEFT JOIN f USING (event_type, k)"""))
def l5_isotonic_by_bucket(spark, sf):
    """One fit per kind of event, all in one job: how often the value is above 60, by k."""
    rows = events(spark, sf).withColumn("y", (F.col("value") > 60).cast("double"))
    return L.isotonic(rows, "k", "y", ["event_type"]).select("event_id", S.rounded("calibrated", 6).alias("calibrated"))


@query(sql("WITH r AS (SELECT event_type, value > 60 AS y, rank() OVER (PARTITION BY event_type ORDER BY k) AS lo, count(*) OVER (PARTITION BY event_type, k) AS ties FROM ev), s AS (SELECT event_type, sum(lo + (ties - 1) / 2.0) FILTER (WHERE y) AS ranks, CAST(count(*) FILTER (WHERE y) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE NOT y) AS DOUBLE) AS n0 FROM r GROUP BY 1) SELECT event_type, round((ranks - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM s"))
def l6_roc_auc(spark, sf):
    return L.auc(events(spark, sf).withColumn("y", F.col("value") > 60), ["event_type"], "k", "y").select("event_type", S.rounded("auc", 6).alias("auc"))


@query(sql("SELECT user_id, t // {D} AS day, min_by(event_id, t) AS event_id FROM ev WHERE value / 500 - 0.1 >= 0.04 GROUP BY 1, 2"))
def l7_margin_rule(spark, sf):
    return L.margin_picks(events(spark, sf).withColumn("day", F.floor(F.col("t") / DAY)).withColumn("p", F.col("value") / 500), "p", F.lit(0.1), 0.04, ["user_id", "day"], "t").select("user_id", "day", "event_id")


@query(sql("WITH c AS (SELECT unnest([0.5, 0.8, 0.9]) AS q), t AS (SELECT q, quantile_cont(value, CASE q WHEN 0.5 THEN 0.5 WHEN 0.8 THEN 0.8 ELSE 0.9 END) AS thr FROM ev, c GROUP BY q) SELECT CAST(q AS DOUBLE) AS q, count(*) AS n, round(avg(CASE WHEN k > 50 THEN 1.0 ELSE 0 END), 6) AS rate FROM ev JOIN t ON value >= thr GROUP BY 1")
       .replace("quantile_cont(value, CASE q WHEN 0.5 THEN 0.5 WHEN 0.8 THEN 0.8 ELSE 0.9 END)", "CASE q WHEN 0.5 THEN quantile_cont(value, 0.5) WHEN 0.8 THEN quantile_cont(value, 0.8) ELSE quantile_cont(value, 0.9) END"))
def l8_confidence_slices(spark, sf):
    return L.slices(events(spark, sf), "value", [0.5, 0.8, 0.9], (F.col("k") > 50).cast("int")).select("q", "n", S.rounded("rate", 6).alias("rate"))


@query(sql("WITH " + CALIBRATION + ", tr0 AS (SELECT band, avg(CASE WHEN up THEN 1.0 ELSE 0 END) AS wr FROM pr WHERE h <= 6 GROUP BY 1), va AS (SELECT band, count(*) AS n, avg(CASE WHEN up THEN 1.0 ELSE 0 END) AS wr FROM pr WHERE h > 6 GROUP BY 1) SELECT band, va.n, round(tr0.wr, 6) AS frozen, round(va.wr, 6) AS realised FROM va JOIN tr0 USING (band)"))
def l9_frozen_calibration_transfer(spark, sf):
    from ..functions.scalar import cut

    d = decisions(spark, sf).withColumn("band", cut("prob", [0.05, 0.1, 0.2], ["a", "b", "c", "d"]))
    wr = F.avg(F.col("up").cast("int"))
    frozen = d.where("h <= 6").groupBy("band").agg(wr.alias("f"))
    return d.where("h > 6").groupBy("band").agg(F.count(F.lit(1)).alias("n"), wr.alias("r")).join(frozen, "band").select("band", "n", S.rounded("f", 6).alias("frozen"), S.rounded("r", 6).alias("realised"))


@query(sql("WITH " + PNL + """, d AS (SELECT day, sum(pnl) AS s FROM p GROUP BY 1), i AS (SELECT s, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM d), z AS (SELECT rep, k, CAST('0x' || substr(md5(rep || ',' || k), 1, 8) AS BIGINT) % any_value(n) AS i FROM i, generate_series(1, 5) r(rep), generate_series(0, 29) g(k) GROUP BY 1, 2),
b AS (SELECT rep, k, s FROM z JOIN i USING (i)), c AS (SELECT rep, k, sum(s) OVER (PARTITION BY rep ORDER BY k) AS cum FROM b), m AS (SELECT rep, max(cum) OVER (PARTITION BY rep ORDER BY k) - cum AS dd FROM c) SELECT rep, round(max(dd), 4) AS max_drawdown FROM m GROUP BY 1"""))
def l10_bootstrap_drawdown(spark, sf):
    return L.bootstrap_drawdown(pnl(spark, sf).groupBy("day").agg(F.sum("pnl").alias("s")), "day", "s", 5, 30).select("rep", S.rounded("max_drawdown", 4).alias("max_drawdown"))


@query(sql("SELECT event_type, CASE WHEN value < 30 THEN 'a' WHEN value < 90 THEN 'b' ELSE 'c' END AS stratum, count(*) AS n, round(avg(k), 6) AS expectancy FROM ev GROUP BY 1, 2"))
def l11_stratified_expectancy(spark, sf):
    from ..functions.scalar import cut

    return events(spark, sf).groupBy("event_type", cut("value", [30, 90], ["a", "b", "c"]).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), S.rounded(F.avg("k"), 6).alias("expectancy"))
