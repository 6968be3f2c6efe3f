"""Tape and book operators B1-B47."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import fills as X
from ..operators import market as M
from ..operators.asof import asof, asof_at, interval_join
from ..operators.dyadic import extremes
from ..operators.grid import conjunction
from .data import DAY, HOUR, LADDER_ORDER, events, fast_feed, fills, ladders, other_quotes, quotes, slow_feed, sql, table, trades
from .q_joins import REGIME_SQL, regimes
from .registry import query


def day_of():
    return F.floor(F.col("t") / DAY)


@query(sql("SELECT user_id, t // (6 * {H}) AS cell, max(t) AS t, max_by(price, t) AS price FROM q GROUP BY 1, 2"))
def b1_grid_downsampling(spark, sf):
    return M.downsample_last(quotes(spark, sf), ["user_id"], "t", 6 * HOUR, ["price"])


@query(sql("SELECT user_id, t // (6 * {H}) AS cell, max_by(price, t) AS price FROM q WHERE t % {D} >= 18 * {H} GROUP BY 1, 2"))
def b2_final_hours_pruning(spark, sf):
    start = day_of() * DAY
    return M.downsample_last(quotes(spark, sf), ["user_id"], "t", 6 * HOUR, ["price"], start + 18 * HOUR, start + DAY).select("user_id", "cell", "price")


WALK = """WITH l AS (SELECT *, price * size AS cost, sum(price * size) OVER (PARTITION BY l_orderkey ORDER BY price, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) - price * size AS before FROM ladder {where}),
n(notional) AS (VALUES (50000.0::DOUBLE), (200000.0::DOUBLE), (1000000.0::DOUBLE)), k AS (SELECT l_orderkey, notional, price, least(cost, greatest(notional - before, 0)) AS take FROM l, n)
SELECT l_orderkey, notional, round(sum(take) / sum(take / price), 6) AS avg_px, round(sum(take / price), 6) AS shares, sum(take) < 0.999 * notional AS exhausted FROM k GROUP BY 1, 2"""
NOTIONALS = [50000.0, 200000.0, 1000000.0]


@query(sql(WALK.replace("{where}", "")))
def b3_book_walk(spark, sf):
    walked = X.walk_ladder(ladders(spark, sf), ["l_orderkey"], "price", "size", LADDER_ORDER, NOTIONALS)
    return walked.select("l_orderkey", "notional", S.rounded("avg_px", 6).alias("avg_px"), S.rounded("shares", 6).alias("shares"), "exhausted")


@query(sql("""WITH l AS (SELECT *, sum(size) OVER (PARTITION BY l_orderkey ORDER BY price, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) - size AS before FROM ladder),
k AS (SELECT l_orderkey, price, least(size, greatest(60 - before, 0)) AS take FROM l) SELECT l_orderkey, sum(take) AS got, round(sum(take * price), 8) AS cost FROM k GROUP BY 1"""))
def b4_walk_for_quantity(spark, sf):
    return X.walk_quantity(ladders(spark, sf), ["l_orderkey"], "price", "size", LADDER_ORDER, (60.0,)).select("l_orderkey", "got", S.rounded("cost", 8).alias("cost"))


@query(sql(WALK.replace("{where}", "WHERE price <= 1500")))
def b5_walk_with_limit(spark, sf):
    levels = ladders(spark, sf).where("price <= 1500")
    walked = X.walk_ladder(levels, ["l_orderkey"], "price", "size", LADDER_ORDER, NOTIONALS, limit=F.lit(1500.0))
    return walked.select("l_orderkey", "notional", S.rounded("avg_px", 6).alias("avg_px"), S.rounded("shares", 6).alias("shares"), "exhausted")


@query(sql("WITH m AS (SELECT *, min(price) OVER (PARTITION BY l_orderkey) AS touch FROM ladder) SELECT l_orderkey, sum(size) FILTER (WHERE price - touch <= 300) AS depth FROM m GROUP BY 1"))
def b6_depth_near_touch(spark, sf):
    touch = F.min("price").over(Window.partitionBy("l_orderkey"))
    return ladders(spark, sf).withColumn("touch", touch).groupBy("l_orderkey").agg(F.sum(F.when(F.col("price") - F.col("touch") <= 300, F.col("size"))).alias("depth"))


SIDES = "s AS (SELECT *, l_linenumber % 2 = 0 AS bid FROM ladder)"


@query(sql("WITH " + SIDES + ", d AS (SELECT l_orderkey, coalesce(sum(size) FILTER (WHERE bid), 0) AS b, coalesce(sum(size) FILTER (WHERE NOT bid), 0) AS a FROM s GROUP BY 1) SELECT l_orderkey, round((b - a) / (b + a), 6) AS imb FROM d"))
def b7_book_imbalance(spark, sf):
    bid = F.col("l_linenumber") % 2 == 0
    depth = ladders(spark, sf).groupBy("l_orderkey").agg(F.sum(F.when(bid, F.col("size")).otherwise(0.0)).alias("b"), F.sum(F.when(~bid, F.col("size")).otherwise(0.0)).alias("a"))
    return depth.select("l_orderkey", S.rounded(S.imbalance("b", "a"), 6).alias("imb"))


@query(sql("SELECT l_orderkey, min(price) AS best, min_by(size, (price, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS best_size, round(sum(price * size), 2) AS usd, count(*) AS levels FROM ladder GROUP BY 1"))
def b8_touch_summary(spark, sf):
    order = F.struct(*LADDER_ORDER)
    return ladders(spark, sf).groupBy("l_orderkey").agg(F.min("price").alias("best"), F.min_by("size", order).alias("best_size"), S.rounded(F.sum(F.col("price") * F.col("size")), 2).alias("usd"), F.count(F.lit(1)).alias("levels"))


@query(sql("""WITH p AS (SELECT q.event_id, q.t, tr.t AS pt, size, CASE WHEN tr.event_id % 2 = 0 THEN 1 ELSE -1 END AS sg FROM q LEFT JOIN tr ON q.user_id = tr.user_id AND tr.t <= q.t),
w AS (SELECT event_id, sum(sg * size) FILTER (WHERE pt > t - 6 * {H}) AS n6, sum(size) FILTER (WHERE pt > t - 6 * {H}) AS g6, count(pt) FILTER (WHERE pt > t - 6 * {H}) AS c6, sum(sg * size) FILTER (WHERE pt > t - {D}) AS n24, sum(size) FILTER (WHERE pt > t - {D}) AS g24,
sum(sg * size) FILTER (WHERE pt > t - {D} AND size >= 50) AS b24, sum(size) FILTER (WHERE pt > t - {D} AND size >= 50) AS bg24, sum(sg * size) AS n, sum(size) AS g FROM p GROUP BY 1)
SELECT event_id, round(n6 / nullif(g6, 0), 6) AS imb_6h, c6 AS prints_6h, round(n24 / nullif(g24, 0), 6) AS imb_24h, round(b24 / nullif(bg24, 0), 6) AS big_imb_24h, round(n / nullif(g, 0), 6) AS imb_open FROM w"""))
def b9_taker_flow(spark, sf):
    sign = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    out = M.flow_features(quotes(spark, sf).select("user_id", "t", "event_id"), trades(spark, sf), ["user_id"], "t", sign, "size", "price", {"6h": 6 * HOUR, "24h": DAY}, 50)
    return out.select("event_id", *(S.rounded(c, 6).alias(c) for c in ("imb_6h", "imb_24h", "big_imb_24h", "imb_open")), "prints_6h")


HORIZONS = (1, 2, 3, 6, 12, 24, 48)


@query(sql("WITH p AS (SELECT event_id, h, t - h * {H} AS t FROM slow, (VALUES (0), " + ", ".join(f"({h})" for h in HORIZONS) + ") v(h)), a AS (SELECT p.event_id, p.h, f.price FROM p ASOF LEFT JOIN fast f ON p.t >= f.t), r AS (SELECT event_id, max(price) FILTER (WHERE h = 0) p0, "
       + ", ".join(f"max(price) FILTER (WHERE h = {h}) p{h}" for h in HORIZONS) + " FROM a GROUP BY 1) SELECT event_id, " + ", ".join(f"round(CASE WHEN p0 > 0 AND p{h} > 0 THEN ln(p0) - ln(p{h}) END, 6) AS ret_{h}h" for h in HORIZONS) + " FROM r"))
def b10_spot_features(spark, sf):
    hours = (0, *HORIZONS)
    long = asof_at(slow_feed(spark, sf).select("event_id", "t"), fast_feed(spark, sf), [], "t", ["price"], {f"h{h}": -h * HOUR for h in hours})
    at = {h: F.ln(F.max(F.when(F.col("step") == f"h{h}", F.col("price")))) for h in hours}
    return long.groupBy("event_id").agg(*(S.rounded(at[0] - at[h], 6).alias(f"ret_{h}h") for h in hours[1:]))


@query(sql("""WITH g AS (SELECT *, CASE WHEN price > 0 THEN price END AS p FROM tr), r AS (SELECT *, last_value(p IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g),
x AS (SELECT q.event_id, sum(CASE WHEN r.event_id % 2 = 0 THEN size ELSE -size END) / CAST(nullif(sum(size), 0) AS DOUBLE) AS ofi, count(size) AS c, max_by(p, (r.t, r.event_id)) FILTER (WHERE p IS NOT NULL) AS last, sum(p * size) / nullif(sum(CASE WHEN p IS NOT NULL THEN size END), 0) AS vwap, sqrt(sum(CASE WHEN p > 0 AND before > 0 THEN ln(p / before) * ln(p / before) END)) AS rvol
FROM q LEFT JOIN r ON q.user_id = r.user_id AND r.t > q.t - 3 * {D} AND r.t <= q.t GROUP BY 1)
SELECT event_id, round(ofi, 6) AS ofi, CASE WHEN c > 0 THEN round(c / 259200.0::DOUBLE, 9) END AS intensity, round(last / nullif(vwap, 0) - 1, 6) AS vwap_dev, round(rvol, 6) AS rvol FROM x"""))
def b10_tape_features(spark, sf):
    sign = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    out = M.tape_features(quotes(spark, sf).select("user_id", "t", "event_id"), trades(spark, sf), ["user_id"], "t", ["event_id"], sign, "size", "price", 3 * DAY)
    return out.select("event_id", S.rounded("ofi", 6).alias("ofi"), S.rounded("intensity", 9).alias("intensity"), S.rounded("vwap_dev", 6).alias("vwap_dev"), S.rounded("rvol", 6).alias("rvol"))


@query(sql("""WITH c AS (SELECT user_id, t // {D} AS day, t, sum(size) OVER (PARTITION BY user_id, t // {D} ORDER BY t) AS v FROM tr), p AS (SELECT event_id, user_id, t // {D} AS day, t FROM q)
SELECT p.event_id, CAST(coalesce(c.v, 0) AS BIGINT) AS so_far FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.day = c.day AND p.t >= c.t"""))
def b11_activity_so_far(spark, sf):
    from ..operators.series import trailing_at

    out = trailing_at(quotes(spark, sf).select("event_id", "user_id", "t", day_of().alias("day")), trades(spark, sf).select("user_id", "t", "size", day_of().alias("day")), ["user_id", "day"], "t", {"v": (F.sum("size"), None)})
    return out.select("event_id", F.coalesce("v", F.lit(0)).alias("so_far"))


@query(sql("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS changes_6h FROM q"))
def b12_change_rate(spark, sf):
    from ..operators.series import trailing

    rows = quotes(spark, sf)
    return rows.select("event_id", F.count(F.lit(1)).over(trailing(rows, ["user_id"], "t", 6 * HOUR)).alias("changes_6h"))


@query(sql("SELECT tr.event_id, tr.t - f.t AS stale_us, round(tr.price - f.price, 6) AS basis FROM tr ASOF LEFT JOIN fast f ON tr.t >= f.t"))
def b13_staleness_and_basis(spark, sf):
    both = asof(trades(spark, sf), fast_feed(spark, sf), [], "t", ["price"], prefix="f_")
    return both.select("event_id", (F.col("t") - F.col("quote_t")).alias("stale_us"), S.rounded(F.col("price") - F.col("f_price"), 6).alias("basis"))


OUTCOMES = """w AS (SELECT generate_series AS day FROM generate_series((SELECT min(t) // {D} FROM ev), (SELECT max(t) // {D} FROM ev))),
o AS (SELECT w.day, s.t AS ot, s.price AS op FROM (SELECT day, day * {D} AS b FROM w) w ASOF LEFT JOIN slow s ON w.b <= s.t), c AS (SELECT w.day, s.t AS ct, s.price AS cp FROM (SELECT day, (day + 1) * {D} AS b FROM w) w ASOF LEFT JOIN slow s ON w.b <= s.t),
oc AS (SELECT day, CASE WHEN ot - day * {D} <= 12 * {H} THEN op END AS open, CASE WHEN ct - (day + 1) * {D} <= 12 * {H} THEN cp END AS close FROM o JOIN c USING (day)), outcomes AS (SELECT day, open, close, close >= open AS up FROM oc)"""


def outcomes(spark, sf, shift_us: int = 0):
    rows = events(spark, sf).agg(F.floor(F.min("t") / DAY).alias("a"), F.floor(F.max("t") / DAY).alias("b"))
    windows = rows.select(F.explode(F.sequence("a", "b")).alias("day")).withColumn("start", F.col("day") * DAY)
    return M.window_outcomes(slow_feed(spark, sf), windows, "t", "price", "start", DAY, 12 * HOUR, shift_us=shift_us)


@query(sql("WITH " + OUTCOMES + " SELECT day, open, close, up FROM outcomes"))
def b14_window_outcomes(spark, sf):
    return outcomes(spark, sf).select("day", "open", "close", "up")


@query(sql("WITH " + OUTCOMES + ", d AS (SELECT t // {D} AS day, max_by(price, t) >= min_by(price, t) AS declared FROM fast GROUP BY 1) SELECT count(*) AS n, round(avg(CASE WHEN up = declared THEN 1.0 ELSE 0 END), 6) AS match_rate FROM outcomes JOIN d USING (day) WHERE up IS NOT NULL"))
def b15_outcome_reconciliation(spark, sf):
    declared = fast_feed(spark, sf).groupBy(day_of().alias("day")).agg((F.max_by("price", "t") >= F.min_by("price", "t")).alias("declared"))
    return outcomes(spark, sf).where("up IS NOT NULL").join(declared, "day").agg(F.count(F.lit(1)).alias("n"), S.rounded(F.avg((F.col("up") == F.col("declared")).cast("int")), 6).alias("match_rate"))


@query(sql("WITH " + OUTCOMES + ", v AS (SELECT t // {D} AS day, sum(size) AS volume, round(sum(size * price), 4) AS notional FROM tr GROUP BY 1) SELECT day, up, CAST(volume AS BIGINT) AS volume, notional, CASE WHEN day < 19740 THEN 0.0624::DOUBLE ELSE 0.07::DOUBLE END AS rate FROM outcomes LEFT JOIN v USING (day)"))
def b16_windows_enrichment(spark, sf):
    volume = trades(spark, sf).groupBy(day_of().alias("day")).agg(F.sum("size").alias("volume"), S.rounded(F.sum(F.col("size") * F.col("price")), 4).alias("notional"))
    return outcomes(spark, sf).join(volume, "day", "left").select("day", "up", "volume", "notional", F.when(F.col("day") < 19740, 0.0624).otherwise(0.07).alias("rate"))


@query("SELECT host, lang, min(page_id) AS page_id FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS lang FROM pages) WHERE host <> '' AND lang <> '' GROUP BY 1, 2")
def b17_calendar_from_metadata(spark, sf):
    from ..operators.series import first_of

    named = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("host"), F.regexp_extract("url", "^https?://[^/]+/([a-z]{2})/", 1).alias("lang")).where("host <> '' AND lang <> ''")
    return first_of(named, ["host", "lang"], [F.col("page_id")])


@query(sql("WITH " + REGIME_SQL + " SELECT taker, count(*) AS n, round(sum(floor(amount * rate * (price * (1 - price)) * 1e5 + 0.5) / 1e5), 5) AS fee FROM fills JOIN regimes ON (lo IS NULL OR date >= lo) AND (hi IS NULL OR date < hi) GROUP BY taker"))
def b18_taker_fee(spark, sf):
    return M.with_fee(fills(spark, sf), regimes(spark), "amount", "price", "date").groupBy("taker").agg(F.count(F.lit(1)).alias("n"), S.rounded(F.sum("fee"), 5).alias("fee"))


@query(sql("WITH " + REGIME_SQL + ", f AS (SELECT round(rate, 3) AS rate, min(date) AS lo FROM fills JOIN regimes ON (lo IS NULL OR date >= lo) AND (hi IS NULL OR date < hi) GROUP BY 1) SELECT lo, lead(lo) OVER (ORDER BY lo) AS hi, rate FROM f"))
def b19_fee_regime_inference(spark, sf):
    """Recovers the regimes from fees that were charged by them."""
    paid = M.with_fee(fills(spark, sf), regimes(spark), "amount", "price", "date")
    implied = S.ratio("fee", F.col("amount") * F.col("price") * (1 - F.col("price")))
    return M.infer_regimes(paid, "date", implied, 1, 1, 3)


@query(sql("WITH " + REGIME_SQL + """, p AS (SELECT date, round(amount * rate * (price * (1 - price)), 5) / (amount * price * (1 - price)) AS implied, rate FROM fills JOIN regimes ON (lo IS NULL OR date >= lo) AND (hi IS NULL OR date < hi)),
d AS (SELECT date, round(median(implied), 3) AS implied, any_value(rate) AS rate FROM p GROUP BY 1) SELECT year(date) AS y, count(*) AS days, count(*) FILTER (WHERE abs(implied - rate) > 0.002) AS off FROM d GROUP BY 1"""))
def b20_fee_audit(spark, sf):
    paid = M.with_fee(fills(spark, sf), regimes(spark), "amount", "price", "date").withColumn("implied", S.ratio("fee", F.col("amount") * F.col("price") * (1 - F.col("price"))))
    daily = paid.groupBy("date").agg(S.rounded(F.median("implied"), 3).alias("implied"), F.first("rate").alias("rate"))
    return daily.groupBy(F.year("date").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("days"), F.count_if(F.abs(F.col("implied") - F.col("rate")) > 0.002).alias("off"))


@query(sql("""WITH o AS (SELECT event_id, user_id, t, price AS lim, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side FROM q), h AS (SELECT o.event_id, tr.t AS pt, size, sum(size) OVER (PARTITION BY o.event_id ORDER BY tr.t, tr.event_id) AS cum
FROM o JOIN tr ON o.user_id = tr.user_id AND tr.t > o.t AND tr.t <= o.t + 3 * {D} WHERE CASE WHEN side = 'buy' THEN tr.price < lim ELSE tr.price > lim END), d AS (SELECT event_id, least(max(cum), 80) AS filled, min(pt) FILTER (WHERE cum >= 80) AS done_at FROM h GROUP BY 1)
SELECT o.event_id, CAST(coalesce(filled, 0) AS BIGINT) AS filled, done_at FROM o LEFT JOIN d USING (event_id)"""))
def b21_trade_through_fill(spark, sf):
    orders = quotes(spark, sf).select("event_id", "user_id", "t", F.col("price").alias("limit"), F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"), F.lit(80).cast("long").alias("qty"))
    return X.level_fills(orders, trades(spark, sf), ["user_id"], "t", "event_id", 3 * DAY).select("event_id", "filled", "done_at")


@query(sql("""WITH x AS (SELECT q.event_id, q.price, max(tr.price) AS hi, min(tr.price) AS lo FROM q LEFT JOIN tr ON q.user_id = tr.user_id AND tr.t > q.t AND tr.t <= (q.t // {D} + 1) * {D} GROUP BY 1, 2)
SELECT event_id, coalesce(lo < price, false) AS buy_through, coalesce(hi >= price, false) AS sell_touch FROM x"""))
def b22_fill_by_path_extreme(spark, sf):
    out = X.path_extremes(quotes(spark, sf).withColumn("until", S.next_boundary("t", DAY)), trades(spark, sf), ["user_id"], "t", "until", "price")
    return out.select("event_id", F.coalesce(F.col("min_after") < F.col("price"), F.lit(False)).alias("buy_through"), F.coalesce(F.col("max_after") >= F.col("price"), F.lit(False)).alias("sell_touch"))


@query(sql("SELECT q.event_id, min(tr.t - q.t) AS tau FROM q LEFT JOIN tr ON q.user_id = tr.user_id AND tr.t > q.t AND tr.t <= q.t + 2 * {D} AND tr.price > 1.2 * q.price GROUP BY 1"))
def b23_first_touch(spark, sf):
    return X.first_touch(quotes(spark, sf), trades(spark, sf), ["user_id"], "t", "event_id", 1.2 * F.col("price"), 2 * DAY).select("event_id", "tau")


@query(sql("""SELECT q.event_id, min(tr.price) AS lowest, greatest(q.price, min(tr.price)) AS fill FROM q JOIN tr ON q.user_id = tr.user_id AND tr.t BETWEEN q.t + {H} AND q.t + {D} AND tr.price <= q.price + 20 GROUP BY q.event_id, q.price"""))
def b24_tape_validated_fill(spark, sf):
    low = extremes(quotes(spark, sf), trades(spark, sf), ["user_id"], "t", "price", HOUR, DAY, "event_id")
    both = quotes(spark, sf).select("event_id", "price").join(low, "event_id").where(F.col("low") <= F.col("price") + 20)
    return both.select("event_id", F.col("low").alias("lowest"), F.greatest("price", "low").alias("fill"))


@query(sql("SELECT q.event_id, min(tr.price) AS low, max(tr.price) AS high FROM q JOIN tr ON q.user_id = tr.user_id AND tr.t BETWEEN q.t + 1000000 AND q.t + {D} GROUP BY 1"))
def b25_tape_bracket(spark, sf):
    return extremes(quotes(spark, sf), trades(spark, sf), ["user_id"], "t", "price", 1_000_000, DAY, "event_id")


@query(sql("""WITH p AS (SELECT event_id, user_id, price, step, t + h * {H} AS t FROM tr, (VALUES ('0h', 0), ('6h', 6), ('24h', 24)) v(step, h)), a AS (SELECT p.event_id, p.step, q.price AS px FROM p ASOF LEFT JOIN q ON p.user_id = q.user_id AND p.t >= q.t),
b AS (SELECT a.step, a.px, z.px AS base FROM a JOIN a z ON a.event_id = z.event_id AND z.step = '0h' WHERE a.px IS NOT NULL AND z.px IS NOT NULL)
SELECT step, count(*) AS n, round(avg(px), 6) AS mean_px, count(*) FILTER (WHERE px > base) AS worse, count(*) FILTER (WHERE px = base) AS same, count(*) FILTER (WHERE px < base) AS better FROM b GROUP BY 1"""))
def b26_latency_table(spark, sf):
    a = asof_at(trades(spark, sf).select("event_id", "user_id", "t"), quotes(spark, sf), ["user_id"], "t", ["price"], {"0h": 0, "6h": 6 * HOUR, "24h": DAY})
    w = Window.partitionBy("event_id")
    b = a.withColumn("base", F.max(F.when(F.col("step") == "0h", F.col("price"))).over(w)).where("price IS NOT NULL AND base IS NOT NULL")
    return b.groupBy("step").agg(F.count(F.lit(1)).alias("n"), S.rounded(F.avg("price"), 6).alias("mean_px"), F.count_if(F.expr("price > base")).alias("worse"), F.count_if(F.expr("price = base")).alias("same"), F.count_if(F.expr("price < base")).alias("better"))


@query(sql("""WITH t AS (SELECT l_orderkey, min(price) AS touch, min_by(price * size, (price, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS rest, sum(price * size) / sum(size) AS deep FROM ladder GROUP BY 1), s(stake) AS (VALUES (20000.0::DOUBLE), (100000.0::DOUBLE))
SELECT l_orderkey, stake, round((least(stake, rest) * touch + greatest(stake - rest, 0) * deep) / stake, 6) AS blended FROM t, s"""))
def b27_blended_fill(spark, sf):
    t = ladders(spark, sf).groupBy("l_orderkey").agg(F.min("price").alias("touch"), F.min_by(F.col("price") * F.col("size"), F.struct(*LADDER_ORDER)).alias("rest"), S.ratio(F.sum(F.col("price") * F.col("size")), F.sum("size")).alias("deep"))
    each = t.withColumn("stake", F.explode(F.array(F.lit(20000.0), F.lit(100000.0))))
    return each.select("l_orderkey", "stake", S.rounded((F.least("stake", "rest") * F.col("touch") + F.greatest(F.col("stake") - F.col("rest"), F.lit(0.0)) * F.col("deep")) / F.col("stake"), 6).alias("blended"))


ZSIG = """WITH p AS (SELECT event_id AS probe, t FROM slow), n AS (SELECT p.probe, p.t, f.price AS now FROM p ASOF LEFT JOIN fast f ON p.t >= f.t), th AS (SELECT p.probe, f.price AS thn FROM (SELECT probe, t - {H} AS t FROM p) p ASOF LEFT JOIN fast f ON p.t >= f.t),
g AS (SELECT probe, i, t - {D} + i * {H} AS t FROM p, generate_series(0, 24) s(i)), gp AS (SELECT g.probe, g.i, f.price FROM g ASOF LEFT JOIN fast f ON g.t >= f.t),
gl AS (SELECT probe, price, lag(price) OVER (PARTITION BY probe ORDER BY i) AS before FROM gp), r AS (SELECT probe, CASE WHEN price > 0 AND before > 0 THEN ln(price) - ln(before) END AS r FROM gl), sg AS (SELECT probe, stddev_pop(r) * 1e4 AS sigma FROM r GROUP BY 1),
z0 AS (SELECT n.probe, n.t, CASE WHEN now > 0 AND thn > 0 THEN 1e4 * ln(now / thn) END AS g, sigma FROM n JOIN th USING (probe) JOIN sg USING (probe)), z AS (SELECT *, CASE WHEN sigma > 0 THEN g / sigma END AS z FROM z0)"""


def zsignals(spark, sf, prices=None):
    return M.zsignal(slow_feed(spark, sf).select(F.col("event_id").alias("probe"), "t"), fast_feed(spark, sf), "t", "price", HOUR, DAY, HOUR, 0, prices=prices)


@query(sql(ZSIG + " SELECT probe, round(g, 4) AS g, round(sigma, 4) AS sigma, round(z, 4) AS z FROM z"))
def b28_return_zsignal(spark, sf):
    return zsignals(spark, sf).select("probe", *(S.rounded(c, 4).alias(c) for c in ("g", "sigma", "z")))


@query(sql("""WITH r AS (SELECT user_id, t, CASE WHEN price > 0 AND lag(price) OVER w > 0 AND t > lag(t) OVER w THEN (ln(price) - ln(lag(price) OVER w)) / sqrt((t - lag(t) OVER w) / 1e6) END AS r FROM q WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT tr.event_id, CASE WHEN count(r) >= 5 THEN round(stddev_pop(r), 8) END AS sigma FROM tr LEFT JOIN r ON tr.user_id = r.user_id AND r.t > tr.t - 10 * {D} AND r.t <= tr.t GROUP BY 1"""))
def b29_irregular_sigma(spark, sf):
    return M.irregular_sigma(trades(spark, sf), quotes(spark, sf), ["user_id"], "t", "price", 10 * DAY, 5).select("event_id", S.rounded("sigma", 8).alias("sigma"))


@query(sql(ZSIG + f" SELECT probe, round({S.normal_cdf_sql('z')}, 6) AS fair FROM z"))
def b30_gaussian_fair_value(spark, sf):
    return zsignals(spark, sf).select("probe", S.rounded(S.normal_cdf("z"), 6).alias("fair"))


@query(sql(f"""WITH p AS (SELECT event_id, t FROM tr), s AS (SELECT t AS src, t + {{H}} AS avail, price FROM slow), a AS (SELECT p.event_id, p.t, s.src, s.price AS anchor FROM p ASOF LEFT JOIN s ON p.t >= s.avail),
b AS (SELECT a.*, f.price AS fa FROM a ASOF LEFT JOIN fast f ON a.src >= f.t), c AS (SELECT b.*, f.price AS fn FROM b ASOF LEFT JOIN fast f ON b.t >= f.t), z AS (SELECT event_id, CASE WHEN anchor > 0 AND fn > 0 AND fa > 0 THEN (ln(anchor / 100) + ln(fn) - ln(fa)) / 2.0 END AS z FROM c)
SELECT event_id, round({S.normal_cdf_sql('z')}, 6) AS fair FROM z"""))
def b31_hybrid_nowcast(spark, sf):
    fast = fast_feed(spark, sf).select("t", "price")
    a = asof(trades(spark, sf).select("event_id", "t"), slow_feed(spark, sf).withColumn("src", F.col("t")), [], "t", ["src", "price"], lag_us=HOUR, prefix="a_").drop("quote_t")
    b = asof(a.withColumnsRenamed({"t": "now", "a_src": "t"}), fast, [], "t", ["price"], prefix="fa_").drop("quote_t", "t")
    c = asof(b.withColumnRenamed("now", "t"), fast, [], "t", ["price"], prefix="fn_")
    z = (F.ln(F.col("a_price") / 100) + F.ln("fn_price") - F.ln("fa_price")) / 2.0
    return c.withColumn("z", z).select("event_id", S.rounded(S.normal_cdf("z"), 6).alias("fair"))


@query(sql(ZSIG + " SELECT probe, CASE WHEN g IS NULL THEN 'nofeed' WHEN sigma IS NULL OR NOT sigma > 0 THEN 'nosigma' WHEN NOT abs(z) >= 0.5 THEN 'z' WHEN NOT g > 0 THEN 'side' ELSE 'pass' END AS gate FROM z"))
def b32_gate_monitor(spark, sf):
    gates = [("nofeed", F.col("g").isNotNull()), ("nosigma", F.col("sigma") > 0), ("z", F.abs("z") >= 0.5), ("side", F.col("g") > 0)]
    return zsignals(spark, sf).select("probe", M.first_failing(gates).alias("gate"))


@query(sql("SELECT tr.event_id, abs(tr.price - f.price) <= 50 AS within_basis FROM tr ASOF LEFT JOIN fast f ON tr.t >= f.t"))
def b33_basis_guard(spark, sf):
    both = asof(trades(spark, sf), fast_feed(spark, sf), [], "t", ["price"], prefix="f_")
    return both.select("event_id", (F.abs(F.col("price") - F.col("f_price")) <= 50).alias("within_basis"))


@query(sql("""WITH p AS (SELECT event_id, user_id, price, h, t + h * {H} AS t FROM tr, (VALUES (6), (12), (24)) v(h)), a AS (SELECT p.event_id, p.h, q.price - p.price AS drift FROM p ASOF LEFT JOIN q ON p.user_id = q.user_id AND p.t >= q.t)
SELECT event_id, round(max(drift) FILTER (WHERE h = 6), 6) AS drift_6h, round(max(drift) FILTER (WHERE h = 12), 6) AS drift_12h, round(max(drift) FILTER (WHERE h = 24), 6) AS drift_24h FROM a GROUP BY 1"""))
def b34_path_labels(spark, sf):
    long = asof_at(trades(spark, sf), quotes(spark, sf), ["user_id"], "t", ["price"], {f"{h}h": h * HOUR for h in (6, 12, 24)}, prefix="q_")
    return long.groupBy("event_id").agg(*(S.rounded(F.max(F.when(F.col("step") == f"{h}h", F.col("q_price") - F.col("price"))), 6).alias(f"drift_{h}h") for h in (6, 12, 24)))


@query(sql("""WITH t AS (SELECT q.event_id, min(tr.t - q.t) AS tau FROM q LEFT JOIN tr ON q.user_id = tr.user_id AND tr.t > q.t AND tr.t <= q.t + {D} AND tr.price > 1.5 * q.price GROUP BY 1),
s AS (SELECT p.event_id, p.price, q.price AS stop FROM (SELECT event_id, user_id, price, t + {D} AS t FROM q) p ASOF LEFT JOIN q ON p.user_id = q.user_id AND p.t >= q.t)
SELECT event_id, CASE WHEN tau IS NOT NULL THEN 'target' ELSE 'timeout' END AS exit_kind, round(CASE WHEN tau IS NOT NULL THEN 1.5 * price ELSE stop END - price, 6) AS pnl FROM s JOIN t USING (event_id)"""))
def b35_barrier_exit(spark, sf):
    touched = X.first_touch(quotes(spark, sf), trades(spark, sf), ["user_id"], "t", "event_id", 1.5 * F.col("price"), DAY)
    stopped = asof(touched.withColumn("t", F.col("t") + DAY), quotes(spark, sf), ["user_id"], "t", ["price"], prefix="stop_")
    hit = F.col("tau").isNotNull()
    return stopped.select("event_id", F.when(hit, "target").otherwise("timeout").alias("exit_kind"), S.rounded(S.barrier_exit(1.5 * F.col("price"), F.col("stop_price"), F.col("price"), hit) - F.col("price"), 6).alias("pnl"))


@query(sql("""WITH x AS (SELECT q.event_id, q.price, max(tr.price) AS hi, min(tr.price) AS lo FROM q LEFT JOIN tr ON q.user_id = tr.user_id AND tr.t > q.t AND tr.t <= (q.t // {D} + 1) * {D} GROUP BY 1, 2)
SELECT band, CASE WHEN hi > price * (1 + band) AND lo < price * (1 - band) THEN 'both' WHEN hi > price * (1 + band) OR lo < price * (1 - band) THEN 'one' ELSE 'none' END AS kind, count(*) AS n FROM x, (VALUES (0.1::DOUBLE), (0.5::DOUBLE)) v(band) GROUP BY 1, 2"""))
def b36_two_sided_levels(spark, sf):
    out = X.path_extremes(quotes(spark, sf).withColumn("until", S.next_boundary("t", DAY)), trades(spark, sf), ["user_id"], "t", "until", "price").withColumn("band", F.explode(F.array(F.lit(0.1), F.lit(0.5))))
    up, down = F.coalesce(F.col("max_after") > F.col("price") * (1 + F.col("band")), F.lit(False)), F.coalesce(F.col("min_after") < F.col("price") * (1 - F.col("band")), F.lit(False))
    return out.groupBy("band", F.when(up & down, "both").when(up | down, "one").otherwise("none").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(sql("""WITH p AS (SELECT event_id, user_id, h, t - h * 6 * {H} AS t FROM tr, (VALUES (0), (1)) v(h)), a AS (SELECT p.event_id, p.h, q.price FROM p ASOF LEFT JOIN q ON p.user_id = q.user_id AND p.t >= q.t), b AS (SELECT p.event_id, p.h, q2.price FROM p ASOF LEFT JOIN q2 ON p.user_id = q2.user_id AND p.t >= q2.t)
SELECT event_id, round((max(a.price) FILTER (WHERE h = 0) - max(a.price) FILTER (WHERE h = 1)) - (max(b.price) FILTER (WHERE h = 0) - max(b.price) FILTER (WHERE h = 1)), 6) AS gap FROM a JOIN b USING (event_id, h) GROUP BY 1"""))
def b37_cross_series_gap(spark, sf):
    steps = {"h0": 0, "h1": -6 * HOUR}
    a = asof_at(trades(spark, sf).select("event_id", "user_id", "t"), quotes(spark, sf), ["user_id"], "t", ["price"], steps, prefix="a_").drop("quote_t")
    both = asof(a, other_quotes(spark, sf), ["user_id"], "t", ["price"], prefix="b_")
    at = lambda c, h: F.max(F.when(F.col("step") == h, F.col(c)))
    return both.groupBy("event_id").agg(S.rounded((at("a_price", "h0") - at("a_price", "h1")) - (at("b_price", "h0") - at("b_price", "h1")), 6).alias("gap"))


@query(sql("WITH b AS (SELECT q.event_id, q.user_id, q.t, q.price AS bid, q2.price AS ask FROM q ASOF JOIN q2 ON q.user_id = q2.user_id AND q.t >= q2.t), l AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t) - t AS life FROM b) SELECT event_id, life FROM l WHERE bid > ask AND life >= {H}"))
def b38_crossed_quotes(spark, sf):
    both = asof(quotes(spark, sf), other_quotes(spark, sf), ["user_id"], "t", ["price"], prefix="ask_").where("ask_price IS NOT NULL")
    return M.crossed_quotes(both, ["user_id"], "t", "price", "ask_price", HOUR).select("event_id", "life")


@query(sql("SELECT count(*) AS n, round(avg(abs(q.price + q2.price - 120)), 6) AS mean_gap FROM q ASOF JOIN q2 ON q.user_id = q2.user_id AND q.t >= q2.t"))
def b39_mirror_consistency(spark, sf):
    both = asof(quotes(spark, sf), other_quotes(spark, sf), ["user_id"], "t", ["price"], prefix="o_").where("o_price IS NOT NULL")
    return both.agg(F.count(F.lit(1)).alias("n"), S.rounded(F.avg(F.abs(F.col("price") + F.col("o_price") - 120)), 6).alias("mean_gap"))


@query(sql("WITH m AS (SELECT s.event_id, min(abs(f.price - s.price)) AS gap FROM slow s LEFT JOIN fast f ON f.t BETWEEN s.t - {H} AND s.t + {H} GROUP BY 1) SELECT event_id, round(gap, 6) AS gap, coalesce(gap <= 5, false) AS ok FROM m"))
def b40_cross_source_reconciliation(spark, sf):
    pairs = interval_join(slow_feed(spark, sf), fast_feed(spark, sf), [], "t", -HOUR, HOUR)
    gaps = pairs.groupBy("event_id").agg(F.min(F.abs(F.col("r_price") - F.col("price"))).alias("gap"))
    return slow_feed(spark, sf).select("event_id").join(gaps, "event_id", "left").select("event_id", S.rounded("gap", 6).alias("gap"), F.coalesce(F.col("gap") <= 5, F.lit(False)).alias("ok"))


@query(sql("WITH g AS (SELECT user_id, day, m, day * {D} + m * {H} AS t FROM (SELECT DISTINCT user_id, t // {D} AS day FROM q), generate_series(2, 22, 5) s(m)) SELECT g.user_id, g.day, g.m, q.price FROM g ASOF LEFT JOIN q ON g.user_id = q.user_id AND g.t >= q.t"))
def b41_resampled_decision_points(spark, sf):
    grid = quotes(spark, sf).select("user_id", day_of().alias("day")).distinct().withColumn("m", F.explode(F.sequence(F.lit(2), F.lit(22), F.lit(5)).cast("array<long>")))
    return asof(grid.withColumn("t", F.col("day") * DAY + F.col("m") * HOUR), quotes(spark, sf), ["user_id"], "t", ["price"]).select("user_id", "day", "m", "price")


@query(sql("""WITH l AS (SELECT *, sum(size) OVER (PARTITION BY l_orderkey ORDER BY price, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) - size AS before FROM ladder), c(clip) AS (VALUES (10.0::DOUBLE), (50.0::DOUBLE), (100.0::DOUBLE)),
k AS (SELECT l_orderkey, clip, price, least(size, greatest(clip - before, 0)) AS take FROM l, c), g AS (SELECT l_orderkey, clip, sum(take) AS got, sum(take * price) AS cost FROM k GROUP BY 1, 2)
SELECT clip, count(*) AS n, round(avg(CASE WHEN got >= clip THEN 1.0 ELSE 0 END), 6) AS fill_rate, round(sum(cost) / sum(got), 4) AS avg_px FROM g GROUP BY 1"""))
def b42_clip_walk(spark, sf):
    walked = X.walk_quantity(ladders(spark, sf), ["l_orderkey"], "price", "size", LADDER_ORDER, (10.0, 50.0, 100.0)).withColumnRenamed("quantity", "clip")
    return walked.groupBy("clip").agg(F.count(F.lit(1)).alias("n"), S.rounded(F.avg((F.col("got") >= F.col("clip")).cast("int")), 6).alias("fill_rate"), S.rounded(S.ratio(F.sum("cost"), F.sum("got")), 4).alias("avg_px"))


@query("""WITH c AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT min(day) AS lo, max(day) AS hi FROM c), cal AS (SELECT CAST(d AS DATE) AS day FROM b, LATERAL (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d))
SELECT day, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n < 3 THEN 'partial' ELSE 'full' END AS state FROM cal LEFT JOIN c USING (day)""")
def b43_coverage_audit(spark, sf):
    return M.coverage(table(spark, sf, "orders"), F.to_date("o_orderdate"), 3)


@query(sql("SELECT q.event_id, lev, lev < 500 - q2.price AS feasible, q.price >= 300 OR q.price <= 200 AS crowd FROM q ASOF JOIN q2 ON q.user_id = q2.user_id AND q.t >= q2.t, (VALUES (50.0::DOUBLE), (400.0::DOUBLE)) v(lev)"))
def b44_level_feasibility(spark, sf):
    both = asof(quotes(spark, sf), other_quotes(spark, sf), ["user_id"], "t", ["price"], prefix="o_").where("o_price IS NOT NULL").withColumn("lev", F.explode(F.array(F.lit(50.0), F.lit(400.0))))
    return both.select("event_id", "lev", (F.col("lev") < 500 - F.col("o_price")).alias("feasible"), ((F.col("price") >= 300) | (F.col("price") <= 200)).alias("crowd"))


@query(sql("""WITH bars AS (SELECT t // {H} AS hr, max_by(price, t) AS close, min_by(price, t) AS open FROM fast GROUP BY 1), r AS (SELECT hr, open, close, CASE WHEN open > 0 AND close > 0 THEN ln(close / open) END AS r FROM bars)
SELECT hr, round(1e4 * r, 4) AS delta, round(1e4 * stddev_pop(r) OVER w, 4) AS sigma FROM r WINDOW w AS (ORDER BY hr RANGE BETWEEN 24 PRECEDING AND 1 PRECEDING)"""))
def b45_bar_window_delta(spark, sf):
    bars = fast_feed(spark, sf).groupBy(F.floor(F.col("t") / HOUR).alias("hr")).agg(F.max_by("price", "t").alias("close"), F.min_by("price", "t").alias("open"))
    w = Window.orderBy("hr").rangeBetween(-24, -1)  # a row per hour of the calendar
    r = bars.withColumn("r", S.log_ratio("close", "open"))
    return r.select("hr", S.rounded(1e4 * F.col("r"), 4).alias("delta"), S.rounded(1e4 * F.stddev_pop("r").over(w), 4).alias("sigma"))


@query(sql("""WITH k AS (SELECT user_id, min(t) // {D} AS a, max(t) // {D} AS b FROM q GROUP BY 1), g AS (SELECT user_id, day, (day + 1) * {D} - 1 AS t FROM k, LATERAL (SELECT unnest(generate_series(a, b)) AS day)), p AS (SELECT g.user_id, g.day, q.price FROM g ASOF LEFT JOIN q ON g.user_id = q.user_id AND g.t >= q.t)
SELECT user_id, day, price, round(price - lag(price) OVER (PARTITION BY user_id ORDER BY day), 6) AS diff FROM p"""))
def b46_segmented_grid(spark, sf):
    keys = quotes(spark, sf).groupBy("user_id").agg(F.floor(F.min("t") / DAY).alias("a"), F.floor(F.max("t") / DAY).alias("b"))
    grid = keys.select("user_id", F.explode(F.sequence("a", "b")).alias("day")).withColumn("t", (F.col("day") + 1) * DAY - 1)
    priced = asof(grid, quotes(spark, sf), ["user_id"], "t", ["price"])
    return priced.select("user_id", "day", "price", S.rounded(F.col("price") - F.lag("price").over(Window.partitionBy("user_id").orderBy("day")), 6).alias("diff"))


@query(sql("SELECT token, count(*) AS n, round(sum(CASE WHEN token = 'Up' THEN price ELSE 1 - price END * amount), 2) AS up_notional, CAST(sum(CASE WHEN (side = 'buy') = (token = 'Up') THEN 1 ELSE -1 END) AS BIGINT) AS dir FROM fills WHERE NOT mirrored GROUP BY 1"))
def b47_economic_events_once(spark, sf):
    up = F.col("token") == "Up"
    return fills(spark, sf).where("NOT mirrored").groupBy("token").agg(F.count(F.lit(1)).alias("n"), S.rounded(F.sum(F.when(up, F.col("price")).otherwise(1 - F.col("price")) * F.col("amount")), 2).alias("up_notional"), F.sum(F.when((F.col("side") == "buy") == up, 1).otherwise(-1)).alias("dir"))
