"""Projections P1-P13, aggregations A1-A18, windows W1-W18, sorts T1-T6, sets U1-U5, scalars F1-F15."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import ranks, series
from ..operators.asof import asof
from .data import DAY, HOUR, events, fast_feed, fills, micros, other_quotes, quotes, slow_feed, sql, table, trades
from .registry import query


def days():
    return F.floor(F.col("t") / DAY).alias("day")


@query("SELECT l_orderkey, CAST(l_quantity AS INTEGER) AS qty, CAST(l_extendedprice AS FLOAT) AS px, 'line' AS kind FROM lineitem")
def p1_select_cast_literal(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").cast("int").alias("qty"), F.col("l_extendedprice").cast("float").alias("px"), F.lit("line").alias("kind"))


@query(sql("""SELECT q2.event_id, round((q2.price + q.price) / 2, 6) AS mid, round(q2.price - q.price, 6) AS spread FROM q2 ASOF JOIN q ON q2.user_id = q.user_id AND q2.t >= q.t"""))
def p2_derived_columns(spark, sf):
    both = asof(other_quotes(spark, sf), quotes(spark, sf), ["user_id"], "t", ["price"], prefix="q_").where("q_price IS NOT NULL")
    return both.select("event_id", S.rounded((F.col("price") + F.col("q_price")) / 2, 6).alias("mid"), S.rounded(F.col("price") - F.col("q_price"), 6).alias("spread"))


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND value IS NOT NULL AND value BETWEEN 20 AND 120 AND user_id > 10")
def p3_compound_filter(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type").isin("view", "click") & F.col("value").isNotNull() & F.col("value").between(20, 120) & (F.col("user_id") > 10)).select("event_id")


@query("SELECT event_id, CASE WHEN value < 50 THEN 'low' WHEN value < 150 THEN 'mid' ELSE 'high' END AS band FROM events")
def p4_conditional(spark, sf):
    return table(spark, sf, "events").select("event_id", F.when(F.col("value") < 50, "low").when(F.col("value") < 150, "mid").otherwise("high").alias("band"))


@query(sql("""WITH r AS (SELECT event_id, user_id, t, floor(price / 50) AS level FROM q), p AS (SELECT *, lag(level) OVER (PARTITION BY user_id ORDER BY t, event_id) AS before FROM r)
SELECT event_id, user_id, level FROM p WHERE before IS NULL OR level <> before"""))
def p5_price_change_dedup(spark, sf):
    levels = quotes(spark, sf).withColumn("level", F.floor(F.col("price") / 50).cast("double"))
    return series.changes_only(levels, ["user_id"], ["t", "event_id"], ["level"]).select("event_id", "user_id", "level")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN round(l_tax / l_discount, 6) END AS ratio FROM lineitem")
def p6_finite_guard(spark, sf):
    ratio = F.when(F.col("l_discount") > 0, F.col("l_tax") / F.col("l_discount"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.rounded(S.finite(ratio), 6).alias("ratio"))


RULES = [("value", ">", 60.0), ("k", "<=", 70.0), ("user_id", ">=", 20.0)]


@query(sql("SELECT event_id FROM ev WHERE value > 60 AND k <= 70 AND user_id >= 20"))
def p7_config_conjunction(spark, sf):
    from ..operators.grid import conjunction

    return events(spark, sf).where(conjunction(RULES)).select("event_id")


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '/([0-9]+)', 1) AS number FROM pages WHERE regexp_matches(url, '^https?://[a-z.]+/[a-z]{2}/[0-9]+')")
def p8_regex_filter_extract(spark, sf):
    return table(spark, sf, "pages").where(F.col("url").rlike("^https?://[a-z.]+/[a-z]{2}/[0-9]+")).select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "/([0-9]+)", 1).alias("number"))


@query("SELECT page_id FROM pages WHERE starts_with(url, 'https://m.')")
def p9_prefix_filter(spark, sf):
    return table(spark, sf, "pages").where(F.col("url").startswith("https://m.")).select("page_id")


@query("SELECT doc_id AS id, lang FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL")
def p10_dropna_drop_rename(spark, sf):
    return table(spark, sf, "documents").dropna(subset=["source", "n_chars"]).drop("text", "source", "n_chars").withColumnRenamed("doc_id", "id")


@query(sql("SELECT side, round(CAST(sum(CASE WHEN side = 'buy' THEN price ELSE 1 - price END * amount) AS DOUBLE), 2) AS cost, count(*) AS n FROM fills GROUP BY side"))
def p11_mirror_transform(spark, sf):
    side = F.when(F.col("side") == "buy", "up").otherwise("down")
    return fills(spark, sf).groupBy("side").agg(S.rounded(F.sum(S.mirrored("price", side) * F.col("amount")), 2).alias("cost"), F.count(F.lit(1)).alias("n"))


@query(sql("SELECT event_id, side, sgn * k AS flow, CASE WHEN side = 'up' THEN price ELSE 500 - price END AS px FROM (SELECT event_id, price, size AS k FROM tr), (VALUES ('up', 1), ('down', -1)) v(side, sgn)"))
def p12_side_relative(spark, sf):
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.lit(g).alias("sgn")) for s, g in (("up", 1), ("down", -1)))))
    both = trades(spark, sf).withColumn("s", sides)
    return both.select("event_id", "s.side", (F.col("s.sgn") * F.col("size")).alias("flow"), F.when(F.col("s.side") == "up", F.col("price")).otherwise(500 - F.col("price")).alias("px"))


@query("SELECT event_id, value FROM events WHERE value >= 40 AND value < 45")
def p13_band_filter(spark, sf):
    return table(spark, sf, "events").where("value >= 40 AND value < 45").select("event_id", "value")


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS avg_px, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag")
def a1_hash_group_by(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), S.rounded(F.sum("l_quantity"), 2).alias("qty"), S.rounded(F.avg("l_extendedprice"), 4).alias("avg_px"), F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi"))


@query("WITH d AS (SELECT o_custkey, o_orderstatus, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_orderstatus, round(sum(s), 2) AS total, CAST(sum(n) AS BIGINT) AS n, count(*) AS customers FROM d GROUP BY 1")
def a2_two_level_aggregate(spark, sf):
    inner = table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.sum("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n"))
    return inner.groupBy("o_orderstatus").agg(S.rounded(F.sum("s"), 2).alias("total"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("customers"))


@query(sql("WITH d AS (SELECT event_type, t // {D} AS day, median(value) AS m, count(*) AS n FROM ev GROUP BY 1, 2) SELECT event_type, round(sum(m * n) / sum(n), 6) AS weighted FROM d GROUP BY 1"))
def a3_weighted_chunk_medians(spark, sf):
    chunks = events(spark, sf).groupBy("event_type", days()).agg(F.median("value").alias("m"), F.count(F.lit(1)).alias("n"))
    return chunks.groupBy("event_type").agg(S.rounded(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("weighted"))


@query("SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q25, round(median(value), 6) AS q50, round(quantile_cont(value, 0.9), 6) AS q90 FROM events GROUP BY 1")
def a4_median_quantiles(spark, sf):
    wide = ranks.quantile_columns(table(spark, sf, "events"), ["event_type"], "value", {"q25": 0.25, "q50": 0.5, "q90": 0.9})
    return wide.select("event_type", *(S.rounded(c, 6).alias(c) for c in ("q25", "q50", "q90")))


@query(sql("""WITH n AS (SELECT 1 + max(t // {D}) - min(t // {D}) AS days, min(t // {D}) AS d0 FROM ev), train AS (SELECT value FROM ev, n WHERE t // {D} < d0 + 0.6 * days)
SELECT DISTINCT round(v, 2) AS threshold FROM (SELECT unnest([quantile_cont(value, 0.1), quantile_cont(value, 0.25), quantile_cont(value, 0.5), quantile_cont(value, 0.75), quantile_cont(value, 0.9)]) AS v FROM train)"""))
def a5_train_thresholds(spark, sf):
    rows = events(spark, sf).withColumn("day", days())
    span = rows.agg(F.min("day").alias("d0"), (F.max("day") - F.min("day") + 1).alias("days"))
    train = rows.join(F.broadcast(span), F.col("day") < F.col("d0") + 0.6 * F.col("days"))
    return ranks.exact_quantiles(train, [], "value", (0.1, 0.25, 0.5, 0.75, 0.9)).select(S.rounded("v", 2).alias("threshold")).distinct()


@query(sql("SELECT user_id, t // {D} AS day, min_by(price, t) AS open, max_by(price, t) AS close FROM q GROUP BY 1, 2"))
def a6_first_last_by_time(spark, sf):
    return quotes(spark, sf).groupBy("user_id", days()).agg(F.min_by("price", "t").alias("open"), F.max_by("price", "t").alias("close"))


@query(sql("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT t // {D}) AS days FROM ev GROUP BY 1"))
def a7_distinct_count(spark, sf):
    return events(spark, sf).withColumn("day", days()).groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("day").alias("days"))


@query("SELECT event_type, round(avg(CASE WHEN value > 100 THEN 1.0 ELSE 0 END), 6) AS rate, count(*) FILTER (WHERE value > 100) AS hits FROM events GROUP BY 1")
def a8_conditional_rate(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(S.rounded(F.avg((F.col("value") > 100).cast("int")), 6).alias("rate"), F.count_if(F.col("value") > 100).alias("hits"))


@query(sql("SELECT user_id, t // {D} AS day, round(sum(size * price), 4) AS notional, sum(size) AS volume FROM tr GROUP BY 1, 2"))
def a9_weighted_notional(spark, sf):
    return trades(spark, sf).groupBy("user_id", days()).agg(S.rounded(F.sum(F.col("size") * F.col("price")), 4).alias("notional"), F.sum("size").alias("volume"))


@query(sql("SELECT q.event_id, max(tr.price) AS max_after, min(tr.price) AS min_after FROM q JOIN tr ON q.user_id = tr.user_id AND tr.t > q.t AND tr.t <= (q.t // {D} + 1) * {D} GROUP BY 1"))
def a10_path_extremes_after(spark, sf):
    from ..operators.fills import path_extremes

    return path_extremes(quotes(spark, sf).withColumn("until", S.next_boundary("t", DAY)), trades(spark, sf), ["user_id"], "t", "until", "price").where("max_after IS NOT NULL").select("event_id", "max_after", "min_after")


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def a11_pearson(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(S.rounded(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(CASE WHEN value >= 75 THEN 1.0 ELSE 0 END), 6) AS share FROM events GROUP BY 1")
def a12_distribution_summary(spark, sf):
    rows = table(spark, sf, "events")
    share = rows.groupBy("event_type").agg(S.rounded(F.avg((F.col("value") >= 75).cast("int")), 6).alias("share"))
    ends = ranks.quantile_columns(rows, ["event_type"], "value", {"p5": 0.05, "p95": 0.95})
    return ranks.join_by(share, ends, ["event_type"]).select("event_type", S.rounded("p5", 6).alias("p5"), S.rounded("p95", 6).alias("p95"), "share")


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def a13_value_counts(spark, sf):
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", S.rounded(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(sql("""SELECT event_type, user_id % 5 AS grp, count(*) FILTER (WHERE t // {D} < 19741) AS train_n, round(avg(value) FILTER (WHERE t // {D} < 19741), 6) AS train_avg, count(*) FILTER (WHERE t // {D} >= 19741) AS val_n,
round(avg(value) FILTER (WHERE t // {D} >= 19741), 6) AS val_avg FROM ev GROUP BY 1, 2"""))
def a14_per_split_metrics(spark, sf):
    train = F.floor(F.col("t") / DAY) < 19741
    cols = [c for name, keep in (("train", train), ("val", ~train)) for c in (F.count_if(keep).alias(f"{name}_n"), S.rounded(F.avg(F.when(keep, F.col("value"))), 6).alias(f"{name}_avg"))]
    return events(spark, sf).groupBy("event_type", (F.col("user_id") % 5).alias("grp")).agg(*cols)


@query(sql("SELECT user_id, round(avg(m), 6) AS cluster_mean, count(*) AS clusters FROM (SELECT user_id, t // {D} AS day, avg(value) AS m FROM ev GROUP BY 1, 2) GROUP BY 1"))
def a15_cluster_means(spark, sf):
    return events(spark, sf).groupBy("user_id", days()).agg(F.avg("value").alias("m")).groupBy("user_id").agg(S.rounded(F.avg("m"), 6).alias("cluster_mean"), F.count(F.lit(1)).alias("clusters"))


@query("SELECT l_partkey, count(*) AS n, round(avg(l_quantity), 6) AS qty FROM lineitem GROUP BY 1 HAVING count(*) >= 30")
def a16_minimum_sample(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), S.rounded(F.avg("l_quantity"), 6).alias("qty")).where("n >= 30")


@query(sql("SELECT event_type, list(m ORDER BY day) AS curve FROM (SELECT event_type, t // {D} AS day, round(avg(value), 4) AS m FROM ev GROUP BY 1, 2) GROUP BY 1"))
def a17_curve_per_group(spark, sf):
    daily = events(spark, sf).groupBy("event_type", days()).agg(S.rounded(F.avg("value"), 4).alias("m"))
    return daily.groupBy("event_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("day", "m"))), lambda x: x["m"]).alias("curve"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def a18_grouping_sets(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.groupingSets([("l_returnflag", "l_linestatus"), ("l_returnflag",), ()], "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), S.rounded(F.sum("l_quantity"), 2).alias("qty"))


def by_user():
    return Window.partitionBy("user_id").orderBy("t", "event_id")


@query(sql("SELECT event_id, round(CASE WHEN price > 0 AND lag(price) OVER w > 0 THEN ln(price) - ln(lag(price) OVER w) END, 6) AS ret FROM q WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)"))
def w1_log_return(spark, sf):
    return quotes(spark, sf).select("event_id", S.rounded(F.ln("price") - F.ln(F.lag("price").over(by_user())), 6).alias("ret"))


@query(sql("SELECT event_id, CAST(sum(size) OVER w AS BIGINT) AS cum_size, round(sum(price * size) OVER w, 4) AS cum_notional, count(*) OVER w AS n FROM tr WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)"))
def w2_prefix_sums(spark, sf):
    w = by_user().rowsBetween(Window.unboundedPreceding, 0)
    return trades(spark, sf).select("event_id", F.sum("size").over(w).alias("cum_size"), S.rounded(F.sum(F.col("price") * F.col("size")).over(w), 4).alias("cum_notional"), F.count(F.lit(1)).over(w).alias("n"))


@query(sql("SELECT event_id, CAST(sum(size) OVER w AS BIGINT) AS flow_12h, count(*) OVER w AS n_12h FROM tr WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 43199999999 PRECEDING AND CURRENT ROW)"))
def w3_trailing_range(spark, sf):
    rows = trades(spark, sf)
    w = series.trailing(rows, ["user_id"], "t", 12 * HOUR)
    return rows.select("event_id", F.sum("size").over(w).alias("flow_12h"), F.count(F.lit(1)).over(w).alias("n_12h"))


@query(sql("""WITH p AS (SELECT user_id, t, event_id, value - 60 AS pnl FROM ev), c AS (SELECT user_id, t, event_id, sum(pnl) OVER (PARTITION BY user_id ORDER BY t, event_id) AS cum FROM p),
d AS (SELECT user_id, max(cum) OVER (PARTITION BY user_id ORDER BY t, event_id) - cum AS dd FROM c) SELECT user_id, round(max(dd), 4) AS max_drawdown FROM d GROUP BY 1"""))
def w4_max_drawdown(spark, sf):
    rows = events(spark, sf).withColumn("pnl", F.col("value") - 60)
    return series.with_drawdown(rows, ["user_id"], ["t", "event_id"], "pnl").groupBy("user_id").agg(S.rounded(F.max("drawdown"), 4).alias("max_drawdown"))


DAILY_UP = """d AS (SELECT user_id, t // {D} AS day, max_by(price, t) >= min_by(price, t) AS up FROM q GROUP BY 1, 2)"""


def daily_up(spark, sf):
    return quotes(spark, sf).groupBy("user_id", days()).agg((F.max_by("price", "t") >= F.min_by("price", "t")).alias("up"))


@query(sql("WITH " + DAILY_UP + " SELECT user_id, day, CASE WHEN lag(day) OVER w + 1 = day THEN lag(up) OVER w END AS prior_up FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)"))
def w5_previous_outcome(spark, sf):
    return series.with_streak(daily_up(spark, sf), ["user_id"], "day", "up", 1).select("user_id", "day", "prior_up")


@query(sql("WITH " + DAILY_UP + """, m AS (SELECT *, CASE WHEN lag(up) OVER w = up AND lag(day) OVER w + 1 = day THEN 0 ELSE 1 END AS new FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY day) AS isl FROM m), l AS (SELECT *, row_number() OVER (PARTITION BY user_id, isl ORDER BY day) * CASE WHEN up THEN 1 ELSE -1 END AS len FROM i)
SELECT user_id, day, coalesce(CASE WHEN lag(day) OVER w + 1 = day THEN lag(len) OVER w END, 0) AS streak FROM l WINDOW w AS (PARTITION BY user_id ORDER BY day)"""))
def w6_signed_streak(spark, sf):
    return series.with_streak(daily_up(spark, sf), ["user_id"], "day", "up", 1).select("user_id", "day", F.col("streak").cast("long").alias("streak"))


@query(sql("""WITH s AS (SELECT user_id, value < 40 AS lost, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - row_number() OVER (PARTITION BY user_id, value < 40 ORDER BY t, event_id) AS g FROM ev)
SELECT user_id, max(n) AS longest FROM (SELECT user_id, g, count(*) AS n FROM s WHERE lost GROUP BY 1, 2) GROUP BY 1"""))
def w7_longest_losing_streak(spark, sf):
    rows = series.with_islands(events(spark, sf).withColumn("lost", F.col("value") < 40), ["user_id"], ["t", "event_id"], "lost")
    return rows.where("lost").groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


@query(sql("""SELECT user_id, CAST(sum(CASE WHEN up IS DISTINCT FROM before THEN 1 ELSE 0 END) AS BIGINT) AS runs FROM (SELECT user_id, value > 50 AS up, lag(value > 50) OVER (PARTITION BY user_id ORDER BY t, event_id) AS before FROM ev) GROUP BY 1"""))
def w8_runs_count(spark, sf):
    rows = series.with_islands(events(spark, sf).withColumn("up", F.col("value") > 50), ["user_id"], ["t", "event_id"], "up")
    return rows.groupBy("user_id").agg(F.max("island").alias("runs"))


@query(sql("SELECT user_id, t // {D} AS day, min_by(event_id, t) AS event_id FROM ev WHERE value > 100 GROUP BY 1, 2"))
def w9_first_event_per_window(spark, sf):
    rows = events(spark, sf).where("value > 100").withColumn("day", days())
    return series.first_of(rows, ["user_id", "day"], [F.col("t"), F.col("event_id")]).select("user_id", "day", "event_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn FROM lineitem) WHERE rn = 1")
def w10_dedup_keep_last(spark, sf):
    order = [F.col("l_shipdate").desc(), "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    return series.first_of(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(sql("""WITH d AS (SELECT user_id % 10 AS grp, t // {D} AS day, sum(value - 60) AS pnl FROM ev GROUP BY 1, 2)
SELECT grp, day, round(sum(pnl) OVER w, 4) AS sum7, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) OVER w, 6) AS share7 FROM d WINDOW w AS (PARTITION BY grp ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""))
def w11_rolling_7_days(spark, sf):
    daily = events(spark, sf).groupBy((F.col("user_id") % 10).alias("grp"), days()).agg(F.sum(F.col("value") - 60).alias("pnl"))
    w = Window.partitionBy("grp").orderBy("day").rowsBetween(-6, 0)
    return daily.select("grp", "day", S.rounded(F.sum("pnl").over(w), 4).alias("sum7"), S.rounded(F.avg((F.col("pnl") > 0).cast("int")).over(w), 6).alias("share7"))


@query(sql("SELECT event_id, CASE WHEN count(*) OVER w >= 20 THEN round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END) OVER w, 6) END AS win_rate FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"))
def w12_rolling_win_rate(spark, sf):
    w = by_user().rowsBetween(-19, 0)
    return events(spark, sf).select("event_id", F.when(F.count(F.lit(1)).over(w) >= 20, S.rounded(F.avg((F.col("value") > 50).cast("int")).over(w), 6)).alias("win_rate"))


@query(sql("SELECT event_id, CASE WHEN count(*) OVER w >= 10 THEN round(avg(value - 60) OVER w / (stddev_samp(value - 60) OVER w / sqrt(count(*) OVER w)), 5) END AS t_stat FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)"))
def w13_rolling_t(spark, sf):
    w, x = by_user().rowsBetween(-39, 0), F.col("value") - 60
    n = F.count(F.lit(1)).over(w)
    return events(spark, sf).select("event_id", F.when(n >= 10, S.rounded(S.ratio(F.avg(x).over(w), F.stddev_samp(x).over(w) / F.sqrt(n)), 5)).alias("t_stat"))


@query(sql("SELECT user_id, day, round(sum(pnl) OVER (PARTITION BY user_id ORDER BY day), 4) AS cum FROM (SELECT user_id, t // {D} AS day, sum(value - 60) AS pnl FROM ev GROUP BY 1, 2)"))
def w14_cumulative_by_day(spark, sf):
    daily = events(spark, sf).groupBy("user_id", days()).agg(F.sum(F.col("value") - 60).alias("pnl"))
    return series.with_drawdown(daily, ["user_id"], ["day"], "pnl").select("user_id", "day", S.rounded("cum", 4).alias("cum"))


@query(sql("SELECT event_id, CAST(least((rn - 1) * 4 // n, 3) AS BIGINT) AS quartile FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM ev)"))
def w15_quartile_by_rank(spark, sf):
    ranked = ranks.with_rank(events(spark, sf).select("event_id", "event_type", "value"), ["event_type"], ["value", "event_id"], "rn", "n")
    return ranked.select("event_id", F.least(F.floor((F.col("rn") - 1) * 4 / F.col("n")), F.lit(3)).cast("long").alias("quartile"))


@query(sql("WITH " + DAILY_UP + " SELECT user_id, day, up, coalesce(lag(up) OVER w, last_value(up) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS shifted FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)"))
def w16_circular_shift(spark, sf):
    w = Window.partitionBy("user_id").orderBy("day")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return daily_up(spark, sf).select("user_id", "day", "up", F.coalesce(F.lag("up").over(w), F.last("up").over(whole)).alias("shifted"))


@query("SELECT o_orderkey, CAST(floor(date_diff('day', min(CAST(o_orderdate AS DATE)) OVER (), CAST(o_orderdate AS DATE)) / 14) AS BIGINT) AS block FROM orders")
def w17_block_index(spark, sf):
    orders = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    first = orders.agg(F.min("day").alias("first"))  # a join with one row, so that no window gathers the table
    return orders.join(F.broadcast(first), F.lit(True)).select("o_orderkey", F.floor(F.datediff("day", "first") / 14).alias("block"))


@query("SELECT o_orderkey, CASE WHEN r * 2 <= n THEN 'train' ELSE 'val' END AS half FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) JOIN (SELECT d, row_number() OVER (ORDER BY d) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)) USING (d)")
def w18_halves_by_date_rank(spark, sf):
    orders = table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))
    days = orders.select("d").distinct()  # a row per calendar day: one window over them is small at any scale
    ranked = days.select("d", F.row_number().over(Window.orderBy("d")).alias("r"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    return orders.join(ranked, "d").select("o_orderkey", F.when(F.col("r") * 2 <= F.col("n"), "train").otherwise("val").alias("half"))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_totalprice DESC, o_orderkey) AS place FROM orders")
def t1_multi_key_sort(spark, sf):
    order = ["o_custkey", F.col("o_totalprice").desc(), "o_orderkey"]
    return ranks.with_rank(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), [], order, "place").select("o_orderkey", "o_custkey", "place")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END DESC NULLS LAST, c_custkey LIMIT 20")
def t2_top_k_nulls_last(spark, sf):
    return table(spark, sf, "customer").orderBy(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).desc_nulls_last(), "c_custkey").limit(20).select("c_custkey", "c_acctbal")


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE rn <= greatest(n // 10, 1)")
def t3_top_decile(spark, sf):
    ranked = ranks.with_rank(table(spark, sf, "customer").select("c_mktsegment", "c_acctbal", "c_custkey"), ["c_mktsegment"], [F.desc("c_acctbal"), "c_custkey"], "rn", "n")
    return ranked.where(F.col("rn") <= F.greatest(F.floor(F.col("n") / 10), F.lit(1))).select("c_custkey")


@query(sql("SELECT tr.event_id, round(abs(tr.price - q.price), 6) AS gap FROM tr ASOF JOIN q ON tr.user_id = q.user_id AND tr.t >= q.t ORDER BY gap DESC, event_id LIMIT 10"))
def t4_worst_k(spark, sf):
    both = asof(trades(spark, sf), quotes(spark, sf), ["user_id"], "t", ["price"], prefix="q_").where("q_price IS NOT NULL")
    return both.select("event_id", S.rounded(F.abs(F.col("price") - F.col("q_price")), 6).alias("gap")).orderBy(F.desc("gap"), "event_id").limit(10)


@query("SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5(CAST(user_id AS VARCHAR) || '-7'), user_id LIMIT 25")
def t5_seeded_sample_of_groups(spark, sf):
    groups = table(spark, sf, "events").select("user_id").distinct()
    return groups.orderBy(F.md5(F.concat(F.col("user_id").cast("string"), F.lit("-7"))), "user_id").limit(25)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def t6_per_group_top_k(spark, sf):
    return series.first_of(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l_partkey AS key, 'line' AS src FROM lineitem WHERE l_quantity > 49 UNION ALL SELECT p_partkey, 'part' FROM part WHERE p_size = 1")
def u1_vertical_union(spark, sf):
    a = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("key"), F.lit("line").alias("src"))
    return a.unionByName(table(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("key"), F.lit("part").alias("src")))


@query("SELECT c_custkey AS key, c_acctbal AS bal, NULL::VARCHAR AS name FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def u2_diagonal_union(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("bal"))
    return a.unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")), allowMissingColumns=True)


@query(sql("SELECT t // {H} AS hour FROM fast INTERSECT SELECT t // {H} FROM slow"))
def u3_intersect(spark, sf):
    hour = F.floor(F.col("t") / HOUR).alias("hour")
    return fast_feed(spark, sf).select(hour).intersect(slow_feed(spark, sf).select(hour))


@query(sql("SELECT t // {H} AS hour FROM fast EXCEPT SELECT t // {H} FROM slow"))
def u4_except(spark, sf):
    hour = F.floor(F.col("t") / HOUR).alias("hour")
    return fast_feed(spark, sf).select(hour).distinct().exceptAll(slow_feed(spark, sf).select(hour).distinct())


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def u5_distinct(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("""SELECT page_id, contains(url, 'example') AS has, upper(substr(url, 1, 5)) AS head, string_split(url, '/')[3] AS host, regexp_extract(url, 'page=([0-9]+)', 1) AS page FROM pages""")
def f1_string_functions(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.contains("url", F.lit("example")).alias("has"), F.upper(F.substring("url", 1, 5)).alias("head"), F.get(F.split("url", "/"), 2).alias("host"), F.regexp_extract("url", "page=([0-9]+)", 1).alias("page"))


@query("""WITH s AS (SELECT o_orderkey, strftime(o_orderdate, '%y%b%d') AS slug FROM orders) SELECT o_orderkey, upper(slug) AS slug, epoch_us(strptime(slug, '%y%b%d')) + 4 * 3600000000 AS open_us FROM s""")
def f2_slug_decoding(spark, sf):
    slug = F.upper(F.date_format("o_orderdate", "yyMMMdd"))
    months = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"
    year, month, day = F.regexp_extract("slug", r"^(\d\d)", 1).cast("int"), F.regexp_extract("slug", r"^\d\d([A-Z]{3})", 1), F.regexp_extract("slug", r"(\d\d)$", 1).cast("int")
    year = F.when(year >= 70, year + 1900).otherwise(year + 2000)
    opened = F.unix_date(F.make_date(year, ((F.position(month, F.lit(months)) + 2) / 3).cast("int"), day)).cast("long") * DAY + 4 * HOUR
    return table(spark, sf, "orders").select("o_orderkey", slug.alias("slug")).select("o_orderkey", "slug", opened.alias("open_us"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days, strftime(o_orderdate, '%Y%m') AS month FROM orders")
def f3_date_functions(spark, sf):
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("iso"), F.datediff(day, F.lit("1995-01-01").cast("date")).cast("long").alias("days"), F.date_format(day, "yyyyMM").alias("month"))


@query("SELECT event_id, CAST(hour(ts) AS BIGINT) AS hour, CAST(dayofweek(ts) AS BIGINT) AS dow FROM events")
def f4_hour_and_weekday(spark, sf):
    seconds = F.floor(micros("ts") / 1_000_000)
    return table(spark, sf, "events").select("event_id", S.hour_of_day(seconds).cast("long").alias("hour"), S.day_of_week(seconds).cast("long").alias("dow"))


@query(sql("SELECT event_id, t // 250000 AS tick, t // 900000000 * 900 AS quarter, (t // {H} + 1) * {H} AS next_hour FROM ev"))
def f5_bucket_floor(spark, sf):
    return events(spark, sf).select("event_id", S.bucket("t", 250_000).alias("tick"), (S.bucket("t", 900_000_000) * 900).alias("quarter"), S.next_boundary("t", HOUR).alias("next_hour"))


@query("SELECT event_id, round(CASE WHEN value > 0 THEN ln(value) END, 6) AS ln_v, round(sqrt(value), 6) AS sqrt_v, round(exp(-value / 100), 6) AS exp_v, CAST(sign(value - 50) AS DOUBLE) AS sgn, least(greatest(value, 20), 100) AS clipped, user_id % 7 AS m FROM events")
def f6_math(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", S.rounded(F.ln(v), 6).alias("ln_v"), S.rounded(F.sqrt(v), 6).alias("sqrt_v"), S.rounded(F.exp(-v / 100), 6).alias("exp_v"), F.signum(v - 50).alias("sgn"), F.least(F.greatest(v, F.lit(20.0)), F.lit(100.0)).alias("clipped"), (F.col("user_id") % 7).alias("m"))


@query(f"SELECT event_id, round({S.normal_cdf_sql('((value - 60) / 40)')}, 6) AS phi FROM events")
def f7_normal_cdf(spark, sf):
    return table(spark, sf, "events").select("event_id", S.rounded(S.normal_cdf((F.col("value") - 60) / 40), 6).alias("phi"))


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_discount > 0.05 THEN l_discount END, -1.0) AS d FROM lineitem")
def f8_null_handling(spark, sf):
    nan = F.when(F.col("l_discount") > 0.05, F.col("l_discount")).otherwise(F.lit(float("nan")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(F.nanvl(nan, F.lit(None)), F.lit(-1.0)).alias("d"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE))), 5) AS s8, CAST(list_position(embedding, list_max(embedding)) AS BIGINT) AS arg, len(list_filter(embedding, lambda x: x > 0)) AS pos FROM embeddings")
def f9_array_functions(spark, sf):
    e = F.col("embedding")
    s8 = F.aggregate(F.transform(F.slice(e, 1, 8), lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf, "embeddings").select("vec_id", S.rounded(s8, 5).alias("s8"), F.array_position(e, F.array_max(e)).alias("arg"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("pos"))


@query("SELECT l_orderkey, list(l_quantity ORDER BY l_quantity, l_partkey)[1] AS least, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1")
def f10_nested_sort_walk(spark, sf):
    nested = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_quantity", "l_partkey"))).alias("levels"))
    return nested.select("l_orderkey", F.col("levels")[0]["l_quantity"].alias("least"), S.rounded(F.aggregate("levels", F.lit(0.0), lambda a, x: a + x["l_quantity"]), 2).alias("total"))


@query(sql("SELECT event_id, '{\"k\":' || k || ',\"op\":\">\"}' AS rule, k AS back FROM ev"))
def f11_json(spark, sf):
    rule = F.to_json(F.struct("k", F.lit(">").alias("op")))
    return events(spark, sf).select("event_id", rule.alias("rule"), F.from_json(rule, "k long, op string")["k"].alias("back"))


@query("SELECT event_type, count(DISTINCT user_id) AS ids FROM events GROUP BY 1")
def f12_hash_identifiers(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.countDistinct(F.xxhash64("user_id")).alias("ids"))


@query("SELECT CASE WHEN value < 20 THEN 'a' WHEN value < 60 THEN 'b' WHEN value < 120 THEN 'c' ELSE 'd' END AS bin, count(*) AS n FROM events GROUP BY 1")
def f13_binning(spark, sf):
    return table(spark, sf, "events").groupBy(S.cut("value", [20, 60, 120], ["a", "b", "c", "d"]).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


CURVE = [(0.0, 0.0), (50.0, 0.4), (150.0, 0.7), (300.0, 0.9), (600.0, 1.0)]


@query(sql("""WITH c(x, y) AS (VALUES (0.0, 0.0), (50.0, 0.4), (150.0, 0.7), (300.0, 0.9), (600.0, 1.0)), s AS (SELECT x AS lo, lead(x) OVER (ORDER BY x) AS hi, y AS ylo, lead(y) OVER (ORDER BY x) AS yhi FROM c)
SELECT event_id, round(CAST(ylo AS DOUBLE) + (price - lo) / CAST(hi - lo AS DOUBLE) * CAST(yhi - ylo AS DOUBLE), 6) AS y FROM tr JOIN s ON price >= lo AND price < hi"""))
def f14_linear_interpolation(spark, sf):
    from ..operators.asof import range_lookup

    points = spark.createDataFrame(list(zip(CURVE, CURVE[1:])), "a struct<x:double,y:double>, b struct<x:double,y:double>").select(F.col("a.x").alias("lo"), F.col("b.x").alias("hi"), F.struct("a.x", "a.y", (F.col("b.x") - F.col("a.x")).alias("dx"), (F.col("b.y") - F.col("a.y")).alias("dy")).alias("p"))
    known = range_lookup(trades(spark, sf), points, "price", "lo", "hi", ["p"]).where("p IS NOT NULL")  # the curve ends at its last point
    return known.select("event_id", S.rounded(F.col("p.y") + (F.col("price") - F.col("p.x")) / F.col("p.dx") * F.col("p.dy"), 6).alias("y"))


@query("SELECT page_id, TRY_CAST(regexp_extract(url, '([^/?#]*)[?#]?[^/]*$', 1) AS INTEGER) AS n FROM pages")
def f15_try_cast(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"([^/?#]*)[?#]?[^/]*$", 1).try_cast("int").alias("n"))
