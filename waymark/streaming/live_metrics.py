"""Accuracy while predictions arrive: JSON Lines of predictions as a stream against fixed queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from waymark.functions.scoring import ratio
from waymark.operators.metrics import last_queries
from waymark.sources.schema import PREDICTION_FILE


def predictions_stream(spark: SparkSession, folder: str) -> DataFrame:
    """query_id and selected of prediction files as they appear in a folder."""
    rows = spark.readStream.schema(PREDICTION_FILE).option("mode", "FAILFAST").json(folder)
    return rows.select("query_id", F.col("selected_candidate_id").alias("selected"))


def running_top1(queries: DataFrame, predictions: DataFrame) -> DataFrame:
    """top1_code() over all predictions so far; the state is two counts."""
    gold = last_queries(queries).where("gold is not null").select("query_id", "gold")
    counts = predictions.join(gold, "query_id").groupBy().agg(F.count_if(F.col("selected") == F.col("gold")).alias("correct"), F.count("*").alias("total"))
    return counts.withColumn("top1", ratio(F.col("correct"), F.col("total")))


def to_memory(df: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Run what is there now and stop; the result is the table `name`."""
    return df.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
