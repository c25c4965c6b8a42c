"""Queries over events and the star schema: windows, sessions, streams, joins for scale."""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import running
from quarrylens.session import table
from quarrylens.streaming import streams

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query("""
    SELECT event_type, next_type, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events) WHERE next_type IS NOT NULL GROUP BY 1, 2""")
def event_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Which event follows which, per user."""
    rows = running.previous(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.date_trunc("day", "ts"), ["event_type"], "before")
    pairs = rows.where("before is not null").select(F.col("before.event_type").alias("event_type"), F.col("event_type").alias("next_type"))
    return pairs.where("next_type is not null").groupBy("event_type", "next_type").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT user_id, session, count(*) AS events, min(event_id) AS first_id FROM (
      SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
        SELECT user_id, event_id, ts, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)) GROUP BY 1, 2""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user less than half an hour apart."""
    day, order = F.date_trunc("day", "ts"), ["ts", "event_id"]
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    e = running.previous(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], order, day, ["ts"], "before")
    begins = F.when(F.col("before.ts").isNull() | (seconds("ts") - seconds("before.ts") > 1800), 1).otherwise(0)
    e = e.select("user_id", "event_id", "ts", begins.alias("begins"))
    numbered = running.sum_before(e, ["user_id"], order, day, F.col("begins"), "earlier").withColumn("session", F.col("earlier") + F.col("begins"))
    return numbered.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_id"))


def _events_path(d: str) -> str:
    """The table for a stream: a directory as it is, a file by a pattern that only it matches."""
    path = os.path.join(d, "events.parquet")
    return path if glob.glob(os.path.join(path, "*")) else os.path.join(d, "events.parque[t]")


_WINDOWS = """
    SELECT strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2"""


@query(_WINDOWS)
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by ten minutes and type."""
    e = table(spark, d, "events")
    return e.groupBy(F.window(F.col("ts").cast("timestamp"), "10 minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top")).select(
        F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "top"
    )


@query(_WINDOWS)
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """The same as a stream, with its whole result at the end."""
    path = _events_path(d)
    schema = table(spark, d, "events").schema
    events = streams.read_events(spark, path, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.drained(streams.windowed(events), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "top")


@query("""
    SELECT user_id, sum(round(value))::BIGINT AS spent, count(*) AS events, sum(round(value)) > 1000 AS over FROM events GROUP BY 1""")
def stream_spending(spark: SparkSession, d: str) -> DataFrame:
    """Spending of each user kept as stream state."""
    path = _events_path(d)
    return streams.drained(streams.spending(streams.read_events(spark, path, table(spark, d, "events").schema), 1000), "update")





@query("""
    SELECT l_returnflag, l_linestatus, sum(l_quantity)::DECIMAL(38, 2)::DOUBLE AS quantity, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18, 4))::DOUBLE AS revenue, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    money = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.sum(money).cast("double").alias("revenue"), F.count(F.lit(1)).alias("n")
    )


@query("""
    SELECT n_name, r_name, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18, 4))::DOUBLE AS revenue, count(DISTINCT o_orderkey) AS orders
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    money = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    joined = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("n_name", "r_name").agg(F.sum(money).cast("double").alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


@query("""
    SELECT o.o_orderkey, count(*) AS late_lines FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_shipdate BETWEEN o.o_orderdate + INTERVAL 60 DAY AND o.o_orderdate + INTERVAL 400 DAY GROUP BY 1""")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Lines shipped inside a window after their order: equi-join on the key, range as a residual condition."""
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    inside = (F.col("l_shipdate") >= F.col("o_orderdate") + F.expr("interval 60 days")) & (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("interval 400 days"))
    return o.join(line, (F.col("l_orderkey") == F.col("o_orderkey")) & inside).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("late_lines"))
