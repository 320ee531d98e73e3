"""Queries over time. Orders happen in January 2024, like events: a day of their dates is 1078 seconds there; a customer acts as the user of the same number modulo 150."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import moments
from waymark.plans.registry import query
from waymark.sources import bindings as B

#: Seconds of January 2024 for a day of orders, users, and seconds of a slot.
DAY, USERS, SLOT = 1078, 150, 86_400


def _moment(date: str) -> Column:
    """The time in January 2024 that stands for a date."""
    days = F.date_diff(F.col(date).cast("date"), F.lit("1995-01-01").cast("date"))
    return F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=days * DAY)


def _moment_sql(date: str) -> str:
    return f"make_timestamp((1704067200 + date_diff('day', DATE '1995-01-01', CAST({date} AS DATE)) * {DAY}) * 1000000)"


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey % {USERS} AS user_id, {_moment_sql('o_orderdate')} AS moment FROM orders),
met AS (SELECT o_orderkey, e.event_id, e.event_type, e.ts, row_number() OVER (PARTITION BY o_orderkey ORDER BY e.ts DESC, e.event_id DESC) AS r FROM o JOIN events e ON e.user_id = o.user_id AND e.ts <= o.moment)
SELECT o.o_orderkey, event_id, event_type, CAST(epoch_us(moment) - epoch_us(ts) AS BIGINT) AS age FROM o LEFT JOIN met ON met.o_orderkey = o.o_orderkey AND r = 1""")
def as_of_events(spark: SparkSession, d: str) -> DataFrame:
    """Each order with its user's latest event up to then, and its age in microseconds."""
    orders = B.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % USERS).alias("user_id"), _moment("o_orderdate").alias("at"))
    events = B.table(spark, d, "events").select("user_id", F.col("ts").alias("at"), "event_id", "event_type")
    met = moments.as_of(orders, events, "user_id", "at", SLOT)
    return met.select("o_orderkey", "found.event_id", "found.event_type", (moments.micros(F.col("at")) - moments.micros(F.col("found.at"))).alias("age"))


@query(f"""WITH a AS (SELECT l_orderkey, l_suppkey % {USERS} AS user_id, {_moment_sql('l_shipdate')} AS begin, {_moment_sql('l_shipdate')} + to_seconds(CAST(l_quantity AS BIGINT) * {DAY}) AS until FROM lineitem),
b AS (SELECT user_id, ts AS begin, ts + to_seconds(3600) AS until FROM events)
SELECT l_orderkey, count(*) AS n_events, CAST(sum(epoch_us(least(a.until, b.until)) - epoch_us(greatest(a.begin, b.begin))) AS BIGINT) AS micros_shared FROM a JOIN b ON a.user_id = b.user_id AND a.begin < b.until AND b.begin < a.until GROUP BY l_orderkey""")
def interval_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """For each order how many hours after an event overlap with a line's time in shipping (a day for each of its quantity), and by how much."""
    ship = _moment("l_shipdate")
    lines = B.table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % USERS).alias("user_id"), ship.alias("begin"), (ship + F.make_dt_interval(secs=F.col("l_quantity").cast("int") * DAY)).alias("until"))
    hours = B.table(spark, d, "events").select("user_id", F.col("ts").alias("begin"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("until"))
    met = moments.overlaps(lines, hours, "user_id", SLOT // 2)
    shared = F.sum(moments.micros(F.col("until")) - moments.micros(F.col("begin")))
    return met.groupBy(F.col("a.l_orderkey").alias("l_orderkey")).agg(F.count("*").alias("n_events"), shared.alias("micros_shared"))


@query("""SELECT event_id, count(*) OVER w AS uses, count(*) FILTER (WHERE event_type = 'error') OVER w AS failures, max(ts) OVER w AS last_use
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)""")
def history_recent(spark: SparkSession, d: str) -> DataFrame:
    """Uses and failures of each event's user in the seven days before it, and the last use then."""
    figures = {"uses": F.count("*"), "failures": F.count_if(F.col("event_type") == "error"), "last_use": F.max("ts")}
    return moments.recently(B.table(spark, d, "events"), "user_id", "ts", figures, 7).select("event_id", "uses", "failures", "last_use")
