"""Queries that replay tables as streams, in SLICES of time; their results are those of the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.plans.registry import query
from waymark.plans.times import DAY, _moment, _moment_sql
from waymark.sources import bindings as B
from waymark.streaming import histories
from waymark.streaming.replay import replay, slices, state_in_rocksdb

SLICES = 3


def _beat(df: DataFrame, at: str, seconds: int) -> DataFrame:
    """One row so much later than all others that nothing stays open; all else in it is null."""
    last = df.agg((F.max(at) + F.make_dt_interval(secs=F.lit(seconds))).alias(at))
    return last.select(*(F.col(at) if f.name == at else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema)).where(F.col(at).isNotNull())


@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM e)
SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 6 HOURS AS until, count(*) AS n_events, max(value) AS most, min(event_id) AS first_id FROM s GROUP BY user_id, n""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Users' sessions, six hours apart, from a stream of event files."""
    events = B.table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    steps = [{"events": part} for part in [*slices(events, "ts", SLICES), _beat(events, "ts", 86_400)]]
    figures = {"n_events": F.count("event_id"), "most": F.max("value"), "first_id": F.min("event_id")}
    found = replay(steps, lambda s: histories.sessions(s["events"], "user_id", "ts", "6 hours", "1 hour", figures))
    return found.where("n_events > 0").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("begin", "until")})


@query("""SELECT event_id, count(*) OVER w AS uses_before, last_value(event_type) OVER w AS last_before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def history_stream(spark: SparkSession, d: str) -> DataFrame:
    """feature_history kept as state over a stream of event files."""
    events = B.table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), "event_id", F.col("event_type").alias("outcome"))
    with state_in_rocksdb(spark):
        return replay([{"events": part} for part in slices(events, "at", SLICES)], lambda s: histories.element_history(s["events"], 90 * 86_400_000, "1 hour"))


@query(f"""WITH g AS (SELECT o_orderkey, o_custkey % 4 AS gold, {_moment_sql('o_orderdate')} AS asked FROM orders)
SELECT o_orderkey AS query_id, CAST(o_orderkey % 4 AS BIGINT) AS selected, CAST(gold AS BIGINT) AS gold FROM g WHERE o_orderkey % 90 <= 60""")
def predictions_met(spark: SparkSession, d: str) -> DataFrame:
    """Predictions and gold ids as two streams; a prediction counts if it was made within an hour of its query. It comes as many minutes later as the order's number modulo 90."""
    orders = B.table(spark, d, "orders").withColumn("asked_at", _moment("o_orderdate").cast("timestamp"))
    gold = orders.select(F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") % 4).alias("gold"), "asked_at")
    made = orders.select(F.col("o_orderkey").alias("query_id"), (F.col("o_orderkey") % 4).alias("selected"), (F.col("asked_at") + F.make_dt_interval(mins=(F.col("o_orderkey") % 90).cast("int"))).alias("made_at"))
    steps = [{"predictions": p, "gold": g} for p, g in zip(slices(made, "made_at", SLICES), slices(gold, "asked_at", SLICES), strict=True)]
    met = replay(steps, lambda s: histories.met_gold(s["predictions"], s["gold"], "1 HOUR", f"{10 * DAY} seconds"))
    return met.select("query_id", "selected", "gold")
