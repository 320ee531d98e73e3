"""Candidates of queries: proposal, scoring, ranking, abstention, and what is handed on.

Everything after flatten() keeps query_id as its one partitioning key, so that features, softmax
and ranking share a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.scoring import clean

#: A matcher turns queries into predictions; use it with DataFrame.transform.
Matcher = Callable[[DataFrame], DataFrame]

def flatten(queries: DataFrame) -> DataFrame:
    """A row for each candidate: query_id, pos and the candidate's fields."""
    return queries.select("query_id", F.posexplode("target_candidates").alias("pos", "c")).select("query_id", "pos", "c.*")


def nest(candidates: DataFrame, *fields: str) -> DataFrame:
    """Candidates back into one array for each query, in order of pos."""
    rows = F.array_sort(F.collect_list(F.struct("pos", *fields)))
    return candidates.groupBy("query_id").agg(F.transform(rows, lambda c: F.struct(*(c[f].alias(f) for f in fields))).alias("target_candidates"))


def nest_variants(candidates: DataFrame) -> DataFrame:
    """nest() for candidates with variants, which can't be sorted: arrays are put in order by pos alone."""
    rows = F.collect_list(F.struct("pos", "candidate_id", "bbox", "metadata"))
    ordered = F.array_sort(rows, lambda a, b: a["pos"] - b["pos"])
    fields = ("candidate_id", "bbox", "metadata")
    return candidates.groupBy("query_id").agg(F.transform(ordered, lambda c: F.struct(*(c[f].alias(f) for f in fields))).alias("target_candidates"))


def propose(elements: DataFrame, plausible: Column) -> DataFrame:
    """First layer: the elements of a screen that can be a target."""
    return elements.where(plausible)


def linear_score(weights: dict[str, float]) -> Column:
    """Second layer: a weighted sum of feature columns."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.col(name) * F.lit(weight)
    return total


def top(candidates: DataFrame, k: int = 1) -> DataFrame:
    """The k best candidates of each query, with rank; NaN and null scores last, ties by pos."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), F.col("pos").asc())
    ranked = candidates.withColumn("score", clean(F.col("score"))).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def with_null_target(candidates: DataFrame, queries: DataFrame, null_score: float) -> DataFrame:
    """Candidates and, for every query, one more without an id: the target is absent. It loses ties."""
    nothing = queries.select("query_id", F.lit(2**31 - 1).alias("pos"), F.lit(None).cast("string").alias("candidate_id"), F.lit(float(null_score)).alias("score"))
    return candidates.select("query_id", "pos", "candidate_id", "score").unionByName(nothing)


def select_or_abstain(candidates: DataFrame, queries: DataFrame, null_score: float, margin: float = 0.0) -> DataFrame:
    """query_id and selected: the best candidate, or null if the absent target scores more or the best two are within `margin`."""
    best = top(with_null_target(candidates, queries, null_score), 2)
    row = best.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("candidate_id"))).alias("first"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"),
    )
    sure = (F.col("s1") - F.coalesce("s2", F.lit(float("-inf")))) >= margin
    return row.select("query_id", F.when(sure, F.col("first")).alias("selected"))


def predictions(candidates: DataFrame) -> DataFrame:
    """A prediction for each query: selected_candidate_id (as top() ranks) and the map of scores (of equal ids the last counts).

    One grouping by query_id, so the candidates are made once.
    """
    best = F.max_by("candidate_id", F.struct(clean(F.col("score")), -F.col("pos")))
    listed = F.sort_array(F.collect_list(F.struct("candidate_id", "pos", "score")))
    rows = candidates.where("query_id is not null").groupBy("query_id").agg(best.alias("selected_candidate_id"), listed.alias("c"))
    last = F.filter("c", lambda x, i: F.get("c", i + 1).isNull() | (F.get("c", i + 1)["candidate_id"] != x["candidate_id"]))
    scores = F.map_from_entries(F.transform(last, lambda x: F.struct(x["candidate_id"], x["score"])))
    return rows.select("query_id", "selected_candidate_id", scores.alias("scores"))


def replay_action(selected: DataFrame, recorded: DataFrame, boxes: DataFrame) -> DataFrame:
    """The recorded operation at the center of the chosen candidate's box; without a choice no point."""
    chosen = selected.join(boxes, [selected["query_id"] == boxes["query_id"], selected["selected"] == boxes["candidate_id"]], "left").select(selected["query_id"], "selected", "bbox")
    middle = lambda a, b: (F.col(f"bbox.{a}") + F.col(f"bbox.{b}")) / 2
    return recorded.join(chosen, "query_id").select("query_id", "operation", "selected", middle("x0", "x1").alias("point_x"), middle("y0", "y1").alias("point_y"))
