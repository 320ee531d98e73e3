"""What a user runs: import a dataset, evaluate a matcher or predictions made elsewhere, summarize."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.report import format_percent
from waymark.functions.scoring import ratio
from waymark.operators import metrics
from waymark.operators.rank import Matcher
from waymark.sources import schema
from waymark.sources.scratch import save


def import_dataset(spark: SparkSession, source: str, out: str) -> DataFrame:
    """JSON Lines (a path or a registered name) to Parquet, with each row's place in its file; returns what validation finds."""
    queries = schema.load_queries(spark, source)
    queries.write.mode("overwrite").option("compression", "zstd").parquet(out)
    return schema.validate_rows(spark.read.schema(queries.schema).parquet(out))


#: What a report row is reported under.
KEY = ("dataset", "artifact", "split", "matcher", "latency_setting")
COUNTS = ("correct", "total", "gold_null", "gold_concrete", "gold_ambiguous", "false_positive", "abstain_right", "ambiguous_abstained", "wrong_target")


def evaluate(queries: DataFrame, matcher: Matcher | DataFrame, dataset: str, split: str, name: str, artifact: str = "", latency_setting: str = "", latency: DataFrame | None = None) -> DataFrame:
    """One report row; `matcher` makes predictions or is the predictions. `latency` has a column ms, one row for each call."""
    made = matcher if isinstance(matcher, DataFrame) else queries.transform(matcher)
    made = save(made.select("query_id", F.col("selected_candidate_id").alias("selected")))  # counts read them several times
    gold = queries.select("query_id", "ord", F.col("gold_candidate_id").alias("gold"), *(c for c in ("gold_kind",) if c in queries.columns))
    key = dict(zip(KEY, map(F.lit, (dataset, artifact, split, name, latency_setting)), strict=True))
    counts = metrics.report_counts(gold, made)
    counts = counts.withColumns({c: F.lit(0).cast("long") for c in ("gold_ambiguous", "ambiguous_abstained") if c not in counts.columns})
    row = counts.withColumns(key | _rates())
    if latency is None:
        return row.withColumns({"mean_ms": F.lit(None).cast("double"), "p95_ms": F.lit(None).cast("double")})
    took = metrics.latency_summary(latency.withColumn("component", F.lit(name)), "component", "ms").select("mean_ms", "p95_ms")
    return row.withColumns({c: took.select(c).scalar() for c in took.columns})


def _rates() -> dict:
    return {
        "false_positive_rate": ratio(F.col("false_positive"), F.col("gold_null")),
        "abstain_accuracy": ratio(F.col("abstain_right") + F.col("ambiguous_abstained"), F.col("gold_null") + F.col("gold_ambiguous")),
        "wrong_target_rate": ratio(F.col("wrong_target"), F.col("gold_concrete")),
    }


def summarize(reports: list[DataFrame]) -> DataFrame:
    """Report rows of one key added up: counts, safety rates, accuracy as a percentage, and the worst mean and 95th percentile of latency."""
    rows = reduce(DataFrame.unionByName, reports)
    sums = rows.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in COUNTS), F.max("mean_ms").alias("mean_ms"), F.max("p95_ms").alias("p95_ms"))
    return sums.withColumns(_rates() | {"top1": format_percent(F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)))})


def external(model: Callable[[Iterator], Iterator]) -> Matcher:
    """A matcher from a model outside Spark: a function over batches (pandas) of query_id, source (JSON) and candidates (JSON), to batches of query_id, selected_candidate_id and scores."""

    def match(queries: DataFrame) -> DataFrame:
        asked = queries.select("query_id", F.to_json("source").alias("source"), F.to_json("target_candidates").alias("candidates"))
        return asked.mapInPandas(model, "query_id string, selected_candidate_id string, scores map<string,double>")

    return match
