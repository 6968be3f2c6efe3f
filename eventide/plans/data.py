"""Roles of the given tables: which rows are quotes, trades, feeds, ladders and fills.

Spark helpers and the SQL prefix define the same views, so a query and its SQL differ in what they compute only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S

HOUR = 3_600_000_000
DAY = 24 * HOUR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def events(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """(event_id, t, user_id, event_type, value, k); of one type where ``kind`` is given, which the scan filters."""
    rows = table(spark, sf_dir, "events")
    if kind:
        rows = rows.where(F.col("event_type") == kind)
    return rows.select("event_id", micros("ts").alias("t"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def quotes(spark, sf_dir):
    return events(spark, sf_dir, "view").select("user_id", "t", "event_id", F.col("value").alias("price"))


def other_quotes(spark, sf_dir):
    return events(spark, sf_dir, "error").select("user_id", "t", "event_id", F.col("value").alias("price"))


def trades(spark, sf_dir):
    return events(spark, sf_dir, "purchase").select("user_id", "t", "event_id", F.col("value").alias("price"), F.col("k").alias("size"))


def fast_feed(spark, sf_dir):
    return events(spark, sf_dir, "click").select("t", "event_id", F.col("value").alias("price"))


def slow_feed(spark, sf_dir):
    return events(spark, sf_dir, "signup").select("t", "event_id", F.col("value").alias("price"))


def ladders(spark, sf_dir):
    """A ladder per order: levels by price, with a total order."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", S.ratio("l_extendedprice", "l_quantity").alias("price"), F.col("l_quantity").alias("size"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


LADDER_ORDER = ("price", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def fills(spark, sf_dir):
    """A ledger of fills: taker, maker, side, amount, price between 0.01 and 0.99, date."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(
        F.col("o_custkey").alias("taker"), F.col("l_suppkey").alias("maker"), F.when(F.col("l_returnflag") == "A", "sell").otherwise("buy").alias("side"),
        F.when(F.col("l_linestatus") == "F", "Up").otherwise("Down").alias("token"), F.col("l_quantity").alias("amount"),
        (0.01 + 0.98 * (F.col("l_partkey") % 100) / 100.0).alias("price"), F.to_date("o_orderdate").alias("date"), (F.col("l_linenumber") == 7).alias("mirrored"), F.col("o_orderpriority").alias("priority"), F.col("l_orderkey").alias("market"),
    )


#: The same roles in SQL.
PREFIX = f"""WITH ev AS (SELECT event_id, epoch_us(ts) AS t, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
q AS (SELECT user_id, t, event_id, value AS price FROM ev WHERE event_type = 'view'),
q2 AS (SELECT user_id, t, event_id, value AS price FROM ev WHERE event_type = 'error'),
tr AS (SELECT user_id, t, event_id, value AS price, k AS size FROM ev WHERE event_type = 'purchase'),
fast AS (SELECT t, event_id, value AS price FROM ev WHERE event_type = 'click'),
slow AS (SELECT t, event_id, value AS price FROM ev WHERE event_type = 'signup'),
ladder AS (SELECT l_orderkey, l_extendedprice / l_quantity AS price, l_quantity AS size, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
fills AS (SELECT o_custkey AS taker, l_suppkey AS maker, CASE WHEN l_returnflag = 'A' THEN 'sell' ELSE 'buy' END AS side, CASE WHEN l_linestatus = 'F' THEN 'Up' ELSE 'Down' END AS token, l_quantity AS amount,
  0.01::DOUBLE + 0.98::DOUBLE * (l_partkey % 100) / 100.0::DOUBLE AS price, CAST(o_orderdate AS DATE) AS date, l_linenumber = 7 AS mirrored, o_orderpriority AS priority, l_orderkey AS market FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def sql(body: str) -> str:
    """body after the shared views; ``H`` and ``D`` in braces are an hour and a day in microseconds."""
    body = body.replace("{H}", str(HOUR)).replace("{D}", str(DAY)).strip()
    return PREFIX + (", " + body[5:] if body.upper().startswith("WITH ") else body)
