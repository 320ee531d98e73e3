"""Streams of recorded events: sessions, the history of each element, and predictions that meet their gold ids."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def sessions(events: DataFrame, key: str, at: str, gap: str, delay: str, figures: dict[str, Column]) -> DataFrame:
    """key, begin, until and figures of runs of a key's events without a pause of `gap` or more.

    A stream's session comes out, once, when no event of up to `delay` of lateness can belong to it any more; later
    events of passed times are dropped. A table's sessions are all there at once.
    """
    timed = events.withWatermark(at, delay) if events.isStreaming else events
    window = F.session_window(at, gap)
    out = timed.groupBy(key, window).agg(*(f.alias(name) for name, f in figures.items()))
    return out.select(key, F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("until"), *figures)


class ElementHistory(StatefulProcessor):
    """For each event: how often its element was used before, and the last outcome then.

    State for each element: number of uses, last outcome. A timer forgets an element `keep_ms` after its last event,
    by event time. Rows are (key, at, event_id, outcome, micros); those of one trigger are put in order, so a trigger should not hold
    more of one element than fits in a task.
    """

    OUTPUT = "event_id long, uses_before long, last_before string"

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("history", "uses long, outcome string, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["micros", "event_id"], kind="stable")
        uses, outcome, until = self.state.get() if self.state.exists() else (0, None, None)
        outcomes = own["outcome"].tolist()
        out = pd.DataFrame({"event_id": own["event_id"].to_numpy(), "uses_before": range(uses, uses + len(own)), "last_before": [outcome, *outcomes[:-1]]})
        if until is not None:
            self.handle.deleteTimer(until)
        until = int(own["micros"].iloc[-1]) // 1000 + self.keep_ms
        self.handle.registerTimer(until)
        self.state.update((uses + len(own), outcomes[-1], until))
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"event_id": pd.Series(dtype="int64"), "uses_before": pd.Series(dtype="int64"), "last_before": pd.Series(dtype="str")})

    def close(self) -> None:
        pass


def element_history(events: DataFrame, keep_ms: int, delay: str) -> DataFrame:
    """ElementHistory of a stream of (key, at, event_id, outcome); run it with state_in_rocksdb()."""
    rows = events.withWatermark("at", delay).withColumn("micros", F.unix_micros("at"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=ElementHistory(keep_ms), outputStructType=ElementHistory.OUTPUT, outputMode="Append", timeMode="EventTime")


def met_gold(predictions: DataFrame, gold: DataFrame, within: str, delay: str) -> DataFrame:
    """query_id, selected, gold and made_at of predictions made at most `within` after their query.

    predictions: query_id, selected, made_at; gold: query_id, gold, asked_at. Both sides are dropped from
    state when the watermarks of both pass the bound.
    """
    left = predictions.withWatermark("made_at", delay)
    right = gold.withColumnRenamed("query_id", "asked_id").withWatermark("asked_at", delay)
    near = (F.col("query_id") == F.col("asked_id")) & (F.col("made_at") >= F.col("asked_at")) & (F.col("made_at") <= F.col("asked_at") + F.expr(f"INTERVAL {within}"))
    return left.join(right, near).select("query_id", "selected", "gold", "made_at")
