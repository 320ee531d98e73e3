"""Baselines that find a recorded target again without learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.features import inside, overlap_ratio
from waymark.operators.rank import top


def coordinate(points: DataFrame, candidates: DataFrame) -> DataFrame:
    """Replay of the recorded point (query_id, x, y): the candidate whose box holds it, of several the one with the nearest center."""
    near = F.pow((F.col("bbox.x0") + F.col("bbox.x1")) / 2 - F.col("x"), 2) + F.pow((F.col("bbox.y0") + F.col("bbox.y1")) / 2 - F.col("y"), 2)
    hit = points.join(candidates, "query_id").where(inside(F.col("x"), F.col("y"), F.col("bbox")))
    best = top(hit.withColumn("score", -near)).select("query_id", F.col("candidate_id").alias("selected"))
    return points.select("query_id").join(best, "query_id", "left")


def exact_tree(sources: DataFrame, candidates: DataFrame, path: str = "path") -> DataFrame:
    """The candidate at the recorded tree path; none where no or several candidates have it."""
    return _unique(sources, candidates, [path])


def tree_with_anchor(sources: DataFrame, candidates: DataFrame, path: str = "path", anchor: str = "anchor") -> DataFrame:
    """As exact_tree(), and the label of the neighbor must be the recorded one."""
    return _unique(sources, candidates, [path, anchor])


def _unique(sources: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    met = sources.join(candidates, ["query_id", *keys], "left")
    return met.groupBy("query_id").agg(F.when(F.count("candidate_id") == 1, F.max("candidate_id")).alias("selected"))


def text_scorer(pairs: DataFrame, weights: tuple[float, float, float]) -> DataFrame:
    """Weighted sum of text, id and class likeness (columns text, ident, kind); the best candidate of each query."""
    score = F.col("text") * weights[0] + F.col("ident") * weights[1] + F.col("kind") * weights[2]
    return top(pairs.withColumn("score", score)).select("query_id", F.col("candidate_id").alias("selected"), "score")


def from_boxes(predicted: DataFrame, candidates: DataFrame) -> DataFrame:
    """Predicted boxes (query_id, box) of an external model to the candidate that each overlaps most; none without overlap."""
    met = predicted.join(candidates, "query_id").withColumn("score", F.round(overlap_ratio(F.col("box"), F.col("bbox")), 6)).where("score > 0")
    return predicted.select("query_id").join(top(met).select("query_id", F.col("candidate_id").alias("selected")), "query_id", "left")


def history(events: DataFrame, key: str, time: str, outcome: str) -> DataFrame:
    """Adds uses_before and last_before: how often the element was used earlier, and the last outcome then."""
    earlier = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumns({"uses_before": F.count("*").over(earlier), "last_before": F.last(outcome).over(earlier)})
