"""Accuracy, safety, latency and summaries; queries have query_id, ord, gold, predictions query_id, selected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.scoring import ratio


def last_queries(queries: DataFrame) -> DataFrame:
    """Of repeated query ids the last by ord holds, also where its gold is null."""
    last = Window.partitionBy("query_id").orderBy(F.desc("ord"))
    return queries.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r")


def labeled(queries: DataFrame) -> DataFrame:
    """last_queries() without those whose gold_kind, where there is one, is UNLABELED: no metric of absent targets may count these."""
    last = last_queries(queries)
    return last.where(F.coalesce(F.col("gold_kind"), F.lit("")) != "UNLABELED") if "gold_kind" in queries.columns else last


def top1_code(queries: DataFrame, predictions: DataFrame) -> DataFrame:
    """correct, total and accuracy over predictions whose query has a gold id; repeated predictions each count, queries without one don't."""
    met = last_queries(queries).select("query_id", "gold").join(predictions.select("query_id", "selected"), "query_id").where("gold is not null")
    return met.agg(*_top1()).withColumn("top1", ratio(F.col("correct"), F.col("total")))


def _top1() -> list[Column]:
    return [F.count_if(F.col("selected") == F.col("gold")).alias("correct"), F.count_if(F.col("gold").isNotNull()).alias("total")]


def top1_doc(queries: DataFrame, predictions: DataFrame) -> DataFrame:
    """The share of all labeled queries whose selected id is the gold one; absent targets are right where nothing is selected."""
    met = labeled(queries).join(predictions.select("query_id", "selected", F.lit(True).alias("made")), "query_id", "left")
    right = F.coalesce(F.col("made"), F.lit(False)) & F.col("selected").eqNullSafe(F.col("gold"))
    counts = met.agg(F.count_if(right).alias("correct"), F.count("*").alias("total"))
    return counts.withColumn("top1", ratio(F.col("correct"), F.col("total")))


def safety_counts(queries: DataFrame, predictions: DataFrame) -> DataFrame:
    """Counts by what was right and what was selected; every prediction is in one of them.

    Where queries have a gold_kind, ambiguous ones are no absent targets and count in columns of their own.
    """
    kinds = "gold_kind" in queries.columns
    own = ["query_id", "gold", *(["gold_kind"] if kinds else [])]
    met = labeled(queries).select(*own).join(predictions.select("query_id", "selected"), "query_id")
    return met.agg(*(F.count_if(c).alias(name) for name, c in _safety(kinds).items()))


def _safety(kinds: bool) -> dict[str, Column]:
    """What safety_counts() counts of queries met by predictions."""
    unclear = F.coalesce(F.col("gold_kind") == "AMBIGUOUS", F.lit(False)) if kinds else F.lit(False)
    absent, nothing, concrete = F.col("gold").isNull() & ~unclear, F.col("selected").isNull(), F.col("gold").isNotNull() & ~unclear
    more = {"gold_ambiguous": unclear, "ambiguous_abstained": unclear & nothing} if kinds else {}
    return {
        "gold_concrete": concrete, "gold_null": absent, "correct": concrete & (F.col("selected") == F.col("gold")),
        "false_positive": absent & ~nothing, "abstain_right": absent & nothing,
        "wrong_target": concrete & ~nothing & (F.col("selected") != F.col("gold")), "abstain_wrong": concrete & nothing, **more,
    }


def report_counts(queries: DataFrame, predictions: DataFrame) -> DataFrame:
    """top1_code() and, but for its own `correct`, safety_counts(): queries and predictions are put in order and joined once."""
    kinds = "gold_kind" in queries.columns
    own = ["query_id", "gold", *(["gold_kind"] if kinds else [])]
    met = last_queries(queries).select(*own).join(predictions.select("query_id", "selected"), "query_id")
    known = F.coalesce(F.col("gold_kind"), F.lit("")) != "UNLABELED" if kinds else F.lit(True)
    safety = [F.count_if(known & c).alias(name) for name, c in _safety(kinds).items() if name != "correct"]
    return met.agg(*_top1(), *safety).withColumn("top1", ratio(F.col("correct"), F.col("total")))


def safety_rates(queries: DataFrame, predictions: DataFrame) -> DataFrame:
    """False positives of absent targets, right abstentions of absent and ambiguous ones, wrong targets of concrete ones."""
    c = safety_counts(queries, predictions)
    unclear = (F.col("ambiguous_abstained"), F.col("gold_ambiguous")) if "gold_kind" in queries.columns else (F.lit(0), F.lit(0))
    return c.select(
        ratio(F.col("false_positive"), F.col("gold_null")).alias("false_positive_rate"),
        ratio(F.col("abstain_right") + unclear[0], F.col("gold_null") + unclear[1]).alias("abstain_accuracy"),
        ratio(F.col("wrong_target"), F.col("gold_concrete")).alias("wrong_target_rate"),
    )


def report_levels(facts: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Sums of counts by every subset of keys, with `level`: a bit for each key, the first the highest, set where all its values are summed up.

    Rows are summed by all keys first, so that only these sums are repeated for the subsets. A null key is a value like others.
    """
    finest = facts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counts))
    return finest.cube(*keys).agg(F.grouping_id().alias("level"), *(F.sum(c).alias(c) for c in counts))


def latency_summary(rows: DataFrame, component: str, millis: str) -> DataFrame:
    """Mean and exact 95th percentile (linear between ranks) for each component."""
    return rows.groupBy(component).agg(F.count(millis).alias("n"), F.avg(millis).alias("mean_ms"), F.percentile(millis, F.lit(0.95)).alias("p95_ms"))


def dataset_summary(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Numbers of queries, candidates and positives."""
    n = candidates.agg(F.count("*").alias("candidates"))
    q = queries.agg(F.count("*").alias("queries"), F.count("gold").alias("positives"))
    return q.withColumn("candidates", n.scalar()).select("queries", "candidates", "positives")


def split_of(query_id):
    """train, dev or test by the id's hash: 8, 1 and 1 of ten."""
    slot = F.conv(F.substring(F.md5(query_id.cast("binary")), 1, 8), 16, 10).cast("long") % 10
    return F.when(slot < 8, "train").when(slot == 8, "dev").otherwise("test")
