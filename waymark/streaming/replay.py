"""Tables replayed as streams: written in slices of time, and read by one streaming query that goes on after each."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.sources.scratch import place

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def slices(df: DataFrame, at: str, n: int) -> list[DataFrame]:
    """df cut into n parts by the time `at`, of about as many rows each, earlier ones first; null times are in the first."""
    seconds = F.unix_micros(F.col(at).cast("timestamp"))
    edges = df.agg(F.percentile_approx(seconds, [i / n for i in range(1, n)], 10_000)).first()[0] or []
    ends = [None, *sorted(edges), None]
    out = []
    for low, high in zip(ends, ends[1:]):
        part = df
        part = part.where(seconds > low) if low is not None else part
        part = part.where(F.coalesce(seconds <= high, F.lit(low is None))) if high is not None else part
        out.append(part)
    return out


@contextmanager
def state_in_rocksdb(spark: SparkSession):
    """State beyond memory, which timers and several states for a key need; the session's setting holds again afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def replay(steps: list[dict[str, DataFrame]], stream_of: Callable[[dict[str, DataFrame]], DataFrame], progress: list | None = None) -> DataFrame:
    """What a streaming query (made of streams by name) has written after all steps.

    In each step the tables are added to what the streams read, and the query runs until it has taken all of
    that; state and place are those of the checkpoint. `progress` gets each run's reports.
    """
    spark = next(iter(steps[0].values())).sparkSession
    folders = {name: place(spark, f"stream-{name}") for name in steps[0]}
    sink, checkpoint = place(spark, "stream-out"), place(spark, "stream-state")
    schemas = {name: df.schema for name, df in steps[0].items()}
    for step in steps:
        for name, df in step.items():
            df.write.mode("append").parquet(folders[name])
        streams = {name: spark.readStream.schema(schemas[name]).parquet(folder) for name, folder in folders.items()}
        made = stream_of(streams)
        query = made.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        if progress is not None:
            progress += query.recentProgress
    return spark.read.schema(made.schema).parquet(sink)
