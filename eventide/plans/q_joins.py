"""Joins J1-J25."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.asof import asof, asof_at, interval_join, range_lookup
from .data import DAY, HOUR, events, fast_feed, fills, other_quotes, quotes, slow_feed, sql, table, trades
from .registry import query


@query(sql("SELECT tr.event_id, q.t AS quote_t, q.price AS q_price FROM tr ASOF LEFT JOIN q ON tr.user_id = q.user_id AND tr.t >= q.t"))
def j1_asof_backward(spark, sf):
    return asof(trades(spark, sf), quotes(spark, sf), ["user_id"], "t", ["price"], prefix="q_").select("event_id", "quote_t", "q_price")


@query(sql("SELECT tr.event_id, q.t AS quote_t, q.price AS q_price FROM tr ASOF LEFT JOIN q ON tr.user_id = q.user_id AND tr.t > q.t"))
def j2_asof_strict(spark, sf):
    return asof(trades(spark, sf), quotes(spark, sf), ["user_id"], "t", ["price"], allow_exact=False, prefix="q_").select("event_id", "quote_t", "q_price")


@query(sql("""SELECT tr.event_id, CASE WHEN q.t - tr.t <= 12 * {H} THEN q.t END AS quote_t, CASE WHEN q.t - tr.t <= 12 * {H} THEN q.price END AS q_price
FROM tr ASOF LEFT JOIN q ON tr.user_id = q.user_id AND tr.t <= q.t"""))
def j3_asof_forward_tolerance(spark, sf):
    return asof(trades(spark, sf), quotes(spark, sf), ["user_id"], "t", ["price"], direction="forward", tolerance_us=12 * HOUR, prefix="q_").select("event_id", "quote_t", "q_price")


@query(sql("SELECT q2.event_id, q.event_id AS q_event_id, round(abs(q2.price - q.price), 6) AS gap FROM q2 ASOF LEFT JOIN q ON q2.user_id = q.user_id AND q2.t >= q.t"))
def j4_join_asof_frames(spark, sf):
    return asof(other_quotes(spark, sf), quotes(spark, sf), ["user_id"], "t", ["event_id", "price"], prefix="q_").select("event_id", "q_event_id", S.rounded(F.abs(F.col("price") - F.col("q_price")), 6).alias("gap"))


LATENCIES = {"l1h": HOUR, "l6h": 6 * HOUR, "l24h": 24 * HOUR}


@query(sql("""WITH p AS (SELECT event_id, user_id, step, t + h * {H} AS t FROM tr, (VALUES ('l1h', 1), ('l6h', 6), ('l24h', 24)) v(step, h)),
a AS (SELECT p.event_id, p.step, q.price FROM p ASOF LEFT JOIN q ON p.user_id = q.user_id AND p.t >= q.t)
SELECT event_id, max(CASE WHEN step = 'l1h' THEN price END) AS l1h, max(CASE WHEN step = 'l6h' THEN price END) AS l6h, max(CASE WHEN step = 'l24h' THEN price END) AS l24h FROM a GROUP BY event_id"""))
def j5_multi_latency_asof(spark, sf):
    long = asof_at(trades(spark, sf), quotes(spark, sf), ["user_id"], "t", ["price"], LATENCIES, prefix="q_")
    return long.groupBy("event_id").agg(*(F.max(F.when(F.col("step") == n, F.col("q_price"))).alias(n) for n in LATENCIES))


@query(sql("""WITH p AS (SELECT event_id, t, user_id % 10 AS cohort FROM tr), c AS (SELECT t, price, user_id % 10 AS cohort FROM q)
SELECT p.event_id, p.cohort, c.price AS q_price FROM p ASOF LEFT JOIN c ON p.cohort = c.cohort AND p.t >= c.t"""))
def j6_asof_other_key_space(spark, sf):
    cohort = (F.col("user_id") % 10).alias("cohort")
    return asof(trades(spark, sf).select("event_id", "t", cohort), quotes(spark, sf).select("t", "price", cohort), ["cohort"], "t", ["price"], prefix="q_").select("event_id", "cohort", "q_price")


@query(sql("""WITH p AS (SELECT event_id, user_id, h, t - h * {H} AS t FROM tr, (VALUES (0), (1), (6), (24)) v(h)),
a AS (SELECT p.event_id, p.h, q.price FROM p ASOF LEFT JOIN q ON p.user_id = q.user_id AND p.t >= q.t),
w AS (SELECT event_id, max(CASE WHEN h = 0 THEN price END) p0, max(CASE WHEN h = 1 THEN price END) p1, max(CASE WHEN h = 6 THEN price END) p6, max(CASE WHEN h = 24 THEN price END) p24 FROM a GROUP BY event_id)
SELECT event_id, round(p0 - p1, 6) AS vel_1h, round(p0 - p6, 6) AS vel_6h, round(p0 - p24, 6) AS vel_24h FROM w"""))
def j7_lagged_difference(spark, sf):
    long = asof_at(trades(spark, sf), quotes(spark, sf), ["user_id"], "t", ["price"], {f"h{h}": -h * HOUR for h in (0, 1, 6, 24)}, prefix="q_")
    at = {h: F.max(F.when(F.col("step") == f"h{h}", F.col("q_price"))) for h in (0, 1, 6, 24)}
    return long.groupBy("event_id").agg(*(S.rounded(at[0] - at[h], 6).alias(f"vel_{h}h") for h in (1, 6, 24)))


@query(sql("""WITH p AS (SELECT event_id, user_id, t, t // {D} - 1 AS day FROM tr), d AS (SELECT user_id, t, price, t // {D} AS day FROM q)
SELECT p.event_id, d.price AS prev_day_price FROM p ASOF LEFT JOIN d ON p.user_id = d.user_id AND p.day = d.day AND p.t >= d.t"""))
def j8_asof_previous_window(spark, sf):
    day = F.floor(F.col("t") / DAY)
    return asof(trades(spark, sf).withColumn("day", day - 1), quotes(spark, sf).withColumn("day", day), ["user_id", "day"], "t", ["price"], prefix="prev_day_").select("event_id", "prev_day_price")


@query(sql("""WITH p AS (SELECT event_id, t FROM tr), s AS (SELECT t AS src, t + {H} AS avail, price FROM slow),
a AS (SELECT p.event_id, p.t, s.src, s.price AS anchor FROM p ASOF LEFT JOIN s ON p.t >= s.avail),
b AS (SELECT a.*, f.price AS at_anchor FROM a ASOF LEFT JOIN fast f ON a.src >= f.t),
c AS (SELECT b.*, f.price AS at_now FROM b ASOF LEFT JOIN fast f ON b.t - {H} >= f.t)
SELECT event_id, anchor, round(CASE WHEN anchor > 0 AND at_now > 0 AND at_anchor > 0 THEN ln(anchor) + ln(at_now) - ln(at_anchor) END, 6) AS nowcast FROM c"""))
def j9_bitemporal_asof(spark, sf):
    slow = slow_feed(spark, sf).withColumn("src", F.col("t"))
    fast = fast_feed(spark, sf).select("t", "price")
    a = asof(trades(spark, sf).select("event_id", "t"), slow, [], "t", ["src", "price"], lag_us=HOUR, prefix="a_").drop("quote_t")
    b = asof(a.withColumnsRenamed({"t": "now", "a_src": "t"}), fast, [], "t", ["price"], prefix="anchor_").drop("quote_t", "t")
    c = asof(b.withColumn("t", F.col("now") - HOUR), fast, [], "t", ["price"], prefix="now_")
    return c.select("event_id", F.col("a_price").alias("anchor"), S.rounded(F.ln("a_price") + F.ln("now_price") - F.ln("anchor_price"), 6).alias("nowcast"))


@query(sql("SELECT tr.event_id, f.t AS quote_t, f.price AS f_price FROM tr ASOF LEFT JOIN fast f ON tr.t >= f.t"))
def j10_unkeyed_bucketed_asof(spark, sf):
    return asof(trades(spark, sf).select("event_id", "t"), fast_feed(spark, sf), [], "t", ["price"], prefix="f_").select("event_id", "quote_t", "f_price")


@query(sql("""SELECT l.user_id, l.event_id, r.event_id AS same_day_event FROM tr l LEFT JOIN (SELECT user_id, t // {D} AS day, min(event_id) AS event_id FROM q GROUP BY ALL) r
ON l.user_id = r.user_id AND l.t // {D} = r.day"""))
def j11_left_equi_join(spark, sf):
    day = F.floor(F.col("t") / DAY)
    first = quotes(spark, sf).groupBy("user_id", day.alias("day")).agg(F.min("event_id").alias("same_day_event"))
    return trades(spark, sf).withColumn("day", day).join(first, ["user_id", "day"], "left").select("user_id", "event_id", "same_day_event")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def j12_inner_equi_join(spark, sf):
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), S.rounded(F.sum("o_totalprice"), 2).alias("total"))


@query(sql("""WITH days AS (SELECT user_id, t // {D} AS day, count(DISTINCT event_type) AS kinds FROM ev GROUP BY 1, 2)
SELECT event_id, ev.user_id FROM ev JOIN days ON ev.user_id = days.user_id AND t // {D} = day WHERE kinds = 5"""))
def j13_complete_groups(spark, sf):
    rows = events(spark, sf).withColumn("day", F.floor(F.col("t") / DAY))
    complete = rows.groupBy("user_id", "day").agg(F.countDistinct("event_type").alias("kinds")).where("kinds = 5")
    return rows.join(complete, ["user_id", "day"], "left_semi").select("event_id", "user_id")


@query("""SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 3)""")
def j14_tuple_membership(spark, sf):
    lines = table(spark, sf, "lineitem")
    often = lines.groupBy("l_partkey", "l_suppkey").count().where("count >= 3")
    return lines.join(often, ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_partkey", "l_quantity")


@query("""WITH b AS (SELECT min(CAST(o_orderdate AS DATE)) lo, max(CAST(o_orderdate AS DATE)) hi FROM orders)
SELECT CAST(d AS DATE) AS missing FROM b, LATERAL (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d) WHERE CAST(d AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""")
def j15_missing_days(spark, sf):
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("missing")).distinct()
    calendar = days.agg(F.min("missing").alias("lo"), F.max("missing").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("missing"))
    return calendar.join(days, "missing", "left_anti")


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j16_dimension_lookup(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


REGIMES = [(None, "1997-01-01", 0.0), ("1997-01-01", "1999-06-01", 0.0624), ("1999-06-01", None, 0.07)]
REGIME_SQL = "regimes(lo, hi, rate) AS (VALUES (NULL::DATE, DATE '1997-01-01', 0.0::DOUBLE), (DATE '1997-01-01', DATE '1999-06-01', 0.0624::DOUBLE), (DATE '1999-06-01', NULL, 0.07::DOUBLE))"


def regimes(spark):
    return spark.createDataFrame(REGIMES, "lo string, hi string, rate double").select(F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"), "rate")


@query(f"""WITH {REGIME_SQL} SELECT rate, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day
FROM orders JOIN regimes ON (lo IS NULL OR CAST(o_orderdate AS DATE) >= lo) AND (hi IS NULL OR CAST(o_orderdate AS DATE) < hi) GROUP BY rate""")
def j17_regime_join(spark, sf):
    dated = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))
    return range_lookup(dated, regimes(spark), "day", "lo", "hi", ["rate"]).groupBy("rate").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(sql("""WITH bands(lo, hi, wr) AS (VALUES (0.0, 50.0, 0.2), (50.0, 150.0, 0.4), (150.0, 400.0, 0.7)) SELECT event_id, CAST(wr AS DOUBLE) AS wr FROM tr LEFT JOIN bands ON price >= lo AND price < hi"""))
def j18_band_lookup(spark, sf):
    bands = spark.createDataFrame([(0.0, 50.0, 0.2), (50.0, 150.0, 0.4), (150.0, 400.0, 0.7)], "lo double, hi double, wr double")
    return range_lookup(trades(spark, sf), bands, "price", "lo", "hi", ["wr"]).select("event_id", "wr")


@query(sql("""SELECT q.event_id, count(tr.t) AS prints, min(tr.price) AS low, max(tr.price) AS high FROM q LEFT JOIN tr ON q.user_id = tr.user_id AND tr.t BETWEEN q.t + {H} AND q.t + 12 * {H} GROUP BY q.event_id"""))
def j19_interval_containment(spark, sf):
    pairs = interval_join(quotes(spark, sf), trades(spark, sf), ["user_id"], "t", HOUR, 12 * HOUR)
    found = pairs.groupBy("event_id").agg(F.count(F.lit(1)).alias("prints"), F.min("r_price").alias("low"), F.max("r_price").alias("high"))
    return quotes(spark, sf).select("event_id").join(found, "event_id", "left").select("event_id", F.coalesce("prints", F.lit(0)).alias("prints"), "low", "high")


@query(sql("""WITH h AS (SELECT user_id, t // {H} AS hour, max(price) AS k FROM q GROUP BY 1, 2)
SELECT a.user_id, a.hour, a.k AS k_now, b.k AS k_then FROM h a JOIN h b ON a.user_id = b.user_id AND a.hour + 6 = b.hour"""))
def j20_self_join_fixed_lead(spark, sf):
    hourly = quotes(spark, sf).groupBy("user_id", F.floor(F.col("t") / HOUR).alias("hour")).agg(F.max("price").alias("k_now"))
    later = hourly.select("user_id", (F.col("hour") - 6).alias("hour"), F.col("k_now").alias("k_then"))
    return hourly.join(later, ["user_id", "hour"])


@query(sql("""WITH h AS (SELECT t // {H} AS hour, max_by(price, t) AS px FROM fast GROUP BY 1), d AS (SELECT event_id, t // {H} AS hour FROM slow)
SELECT d.event_id, w, round(a.px - b.px, 6) AS move FROM d, (VALUES (1), (2), (3), (6)) v(w) LEFT JOIN h a ON a.hour = d.hour - 1 LEFT JOIN h b ON b.hour = d.hour - 1 - w"""))
def j21_exact_offset_lookup(spark, sf):
    hourly = fast_feed(spark, sf).groupBy(F.floor(F.col("t") / HOUR).alias("hour")).agg(F.max_by("price", "t").alias("px"))
    asked = slow_feed(spark, sf).select("event_id", F.floor(F.col("t") / HOUR).alias("hour"), F.explode(F.array(*map(F.lit, (1, 2, 3, 6)))).alias("w"))
    a, b = hourly.select((F.col("hour") + 1).alias("hour"), F.col("px").alias("a")), hourly.select(F.col("hour").alias("then"), F.col("px").alias("b"))
    return asked.join(a, "hour", "left").withColumn("then", F.col("hour") - 1 - F.col("w")).join(b, "then", "left").select("event_id", "w", S.rounded(F.col("a") - F.col("b"), 6).alias("move"))


@query(sql("""WITH c(cid, thr) AS (VALUES (1, 50.0), (2, 100.0), (3, 200.0)) SELECT cid, count(*) AS n, count(*) FILTER (WHERE price > thr) AS hits FROM tr, c GROUP BY cid"""))
def j22_decisions_by_configs(spark, sf):
    configs = spark.createDataFrame([(1, 50.0), (2, 100.0), (3, 200.0)], "cid int, thr double")
    return trades(spark, sf).join(F.broadcast(configs), F.lit(True)).groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("price") > F.col("thr")).alias("hits"))


@query(sql("""WITH days AS (SELECT DISTINCT user_id, t // {D} AS day FROM ev), grid AS (SELECT * FROM days, (VALUES (0), (8), (16)) v(h)),
counts AS (SELECT user_id, t // {D} AS day, (t % {D}) // (8 * {H}) * 8 AS h, count(*) AS n FROM ev GROUP BY 1, 2, 3)
SELECT user_id, day, h, coalesce(n, 0) AS n FROM grid LEFT JOIN counts USING (user_id, day, h)"""))
def j23_dense_scaffold(spark, sf):
    rows = events(spark, sf).withColumn("day", F.floor(F.col("t") / DAY))
    grid = rows.select("user_id", "day").distinct().withColumn("h", F.explode(F.array(*map(F.lit, (0, 8, 16)))))
    counts = rows.groupBy("user_id", "day", (F.floor(F.col("t") % DAY / (8 * HOUR)) * 8).cast("int").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["user_id", "day", "h"], "left").select("user_id", "day", "h", F.coalesce("n", F.lit(0)).alias("n"))


@query(sql("""WITH a AS (SELECT user_id, t // {D} AS day, round(avg(price), 6) AS q_avg FROM q GROUP BY 1, 2), b AS (SELECT user_id, t // {D} AS day, round(avg(price), 6) AS e_avg FROM q2 GROUP BY 1, 2),
c AS (SELECT user_id, t // {D} AS day, sum(size) AS vol FROM tr GROUP BY 1, 2) SELECT user_id, day, vol, q_avg, e_avg FROM c LEFT JOIN a USING (user_id, day) LEFT JOIN b USING (user_id, day)"""))
def j24_feature_stacking(spark, sf):
    day = F.floor(F.col("t") / DAY).alias("day")
    a = quotes(spark, sf).groupBy("user_id", day).agg(S.rounded(F.avg("price"), 6).alias("q_avg"))
    b = other_quotes(spark, sf).groupBy("user_id", day).agg(S.rounded(F.avg("price"), 6).alias("e_avg"))
    return trades(spark, sf).groupBy("user_id", day).agg(F.sum("size").alias("vol")).join(a, ["user_id", "day"], "left").join(b, ["user_id", "day"], "left")


@query(sql("""WITH a AS (SELECT t // {D} AS day, max_by(price, t) AS px FROM slow GROUP BY 1), s AS (SELECT (t + {D}) // {D} AS day, max_by(price, t) AS px FROM slow GROUP BY 1)
SELECT day, a.px AS px, s.px AS px_s, a.px <> s.px AS moved FROM a JOIN s USING (day)"""))
def j25_two_versions(spark, sf):
    build = lambda shift: slow_feed(spark, sf).groupBy(F.floor((F.col("t") + shift) / DAY).alias("day")).agg(F.max_by("price", "t").alias("px"))
    return build(0).join(build(DAY).withColumnRenamed("px", "px_s"), "day").select("day", "px", "px_s", (F.col("px") != F.col("px_s")).alias("moved"))
