"""Streams in several triggers: late rows, state that goes, and results of whole tables."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from waymark.streaming import histories
from waymark.streaming.replay import replay, slices, state_in_rocksdb

START = datetime(2024, 1, 1)


def minutes(n):
    return START + timedelta(minutes=n)


def events(spark, rows):
    return spark.createDataFrame([(u, minutes(m), i) for u, m, i in rows], "user string, ts timestamp, id long")


def test_sessions_close_and_late_rows_are_dropped(spark):
    steps = [
        [("a", 0, 1), ("a", 20, 2), ("b", 5, 3)],
        [("a", 300, 4)],  # the watermark goes to 290: all sessions so far are over
        [("a", 10, 5), ("b", 295, 6)],  # 5 is too late, 6 is within the delay of 10 minutes
        [("a", 900, 7)],
    ]
    progress = []
    found = replay(
        [{"events": events(spark, s)} for s in steps],
        lambda s: histories.sessions(s["events"], "user", "ts", "30 minutes", "10 minutes", {"n": F.count("*"), "first": F.min("id")}),
        progress,
    )
    got = sorted((r["user"], r["begin"], r["until"], r["n"], r["first"]) for r in found.collect())
    assert got == [("a", minutes(0), minutes(50), 2, 1), ("a", minutes(300), minutes(330), 1, 4), ("b", minutes(5), minutes(35), 1, 3), ("b", minutes(295), minutes(325), 1, 6)]
    assert sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]) == 1
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1  # only the last session is open


def test_sessions_of_a_table(spark):
    rows = [("a", 0, 1), ("a", 29, 2), ("a", 70, 3), ("b", 5, 4)]
    found = histories.sessions(events(spark, rows), "user", "ts", "30 minutes", "1 minute", {"n": F.count("*")})
    assert sorted((r["user"], r["n"]) for r in found.collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_element_history_lives_over_triggers_and_is_forgotten(spark):
    steps = [[("a", 0, 1), ("b", 1, 2), ("a", 2, 3)], [("a", 5, 4), ("c", 6, 5)], [("z", 500, 6)], [("a", 501, 7), ("a", 501, 8)]]
    tables = [{"events": events(spark, s).select(F.col("user").alias("key"), F.col("ts").alias("at"), F.col("id").alias("event_id"), F.concat(F.lit("o"), "id").alias("outcome"))} for s in steps]
    with state_in_rocksdb(spark):
        found = replay(tables, lambda s: histories.element_history(s["events"], 60 * 60_000, "10 minutes"))
    got = {r["event_id"]: (r["uses_before"], r["last_before"]) for r in found.collect()}
    assert got == {1: (0, None), 2: (0, None), 3: (1, "o1"), 4: (2, "o3"), 5: (0, None), 6: (0, None), 7: (0, None), 8: (1, "o7")}  # an hour later a is new again
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_predictions_meet_gold_in_time_and_state_goes(spark):
    gold = spark.createDataFrame([(q, "x", minutes(m)) for q, m in [(1, 0), (2, 10), (3, 2000), (4, 2010)]], "query_id long, gold string, asked_at timestamp")
    made = spark.createDataFrame([(1, "x", minutes(60)), (2, "y", minutes(71)), (2, "z", minutes(70)), (3, "x", minutes(1999)), (4, "w", minutes(2015)), (9, "x", minutes(2016))], "query_id long, selected string, made_at timestamp")
    progress = []
    steps = [{"predictions": p, "gold": g} for p, g in zip(slices(made, "made_at", 2), slices(gold, "asked_at", 2), strict=True)]
    steps.append({"predictions": made.where("false"), "gold": gold.where("false")})
    met = replay(steps, lambda s: histories.met_gold(s["predictions"], s["gold"], "1 HOUR", "30 minutes"), progress)
    assert sorted((r["query_id"], r["selected"], r["gold"]) for r in met.collect()) == [(1, "x", "x"), (2, "z", "x"), (4, "w", "x")]
    kept = progress[-1]["stateOperators"][0]["numRowsTotal"]
    assert kept < gold.count() + made.count()  # what is past the bound is gone


def test_slices_hold_every_row_once(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else minutes(i * 13 % 50)) for i in range(60)], "id long, ts timestamp")
    parts = slices(df, "ts", 4)
    ids = [r["id"] for p in parts for r in p.collect()]
    assert sorted(ids) == list(range(60))
    ends = [p.agg(F.min("ts"), F.max("ts")).first() for p in parts]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
