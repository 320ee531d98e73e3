"""Pair features and a ranker over query rows as they come from files (sources and metadata are variants)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import features as X
from waymark.operators import rank

#: Keys that sources and candidates' metadata may have; missing ones make a feature 0.
FLAGS = ("clickable", "editable", "scrollable")
WEIGHTS = {
    "text_overlap": 2.0, "text_likeness": 1.0, "id_overlap": 2.0, "same_class": 0.5, "parent_overlap": 0.5,
    "clickable": 0.25, "editable": 0.25, "scrollable": 0.25, "box_overlap": 1.0, "same_region": 0.25, "distance": -0.5,
}
#: Features that are 0 or 1.
YES_OR_NO = ("same_class", *FLAGS, "same_region")


#: What is read of a candidate's metadata and of a source; fields of other types or missing are null.
ELEMENT = "text string, resource_id string, class string, parent string, " + ", ".join(f"{f} boolean" for f in FLAGS)
SOURCE = f"{ELEMENT}, bbox array<double>, screen array<double>"


def _fields(row: Column) -> Column:
    """An element's fields; null texts are empty."""
    text = {n: F.coalesce(row[n], F.lit("")) for n in ("text", "resource_id", "class", "parent")}
    return F.struct(*(c.alias(n) for n, c in (text | {f: row[f] for f in FLAGS}).items()))


def _parts(row: Column) -> Column:
    """The different parts of an element's texts."""
    parts = {"words": F.split(row["text"], " "), "ids": X.id_parts(row["resource_id"]), "above": F.split(row["parent"], " ")}
    return F.struct(*(F.array_distinct(c).alias(n) for n, c in parts.items()))


CORNERS = ("x0", "y0", "x1", "y1")


def _size(source: Column) -> Column:
    return F.struct(*(F.coalesce(F.get(source["screen"], i), F.lit(1.0)).alias(n) for i, n in enumerate(("w", "h"))))


def _box(source: Column) -> Column:
    """The source's box in shares of its screen."""
    return F.struct(*(F.try_divide(F.get(source["bbox"], i), F.coalesce(F.get(source["screen"], i % 2), F.lit(1.0))).alias(n) for i, n in enumerate(CORNERS)))


def _both(a: Column, b: Column, feature: Column) -> Column:
    """0 where one side has nothing to compare."""
    return F.when((a != "") & (b != ""), feature).otherwise(0.0)


def pair_features(queries: DataFrame) -> DataFrame:
    """A row for each candidate of each query with the features of WEIGHTS.

    The source has text, resource_id, class, parent, flags, bbox (array of corners) and screen
    (width and height, 1 and 1 by default); a candidate's metadata has the same but bbox. Each
    variant is read once, and a source's texts are split before its candidates become rows. As one
    generated method the features would be beyond the 8000 bytes up to which the JVM compiles
    methods; X.distance() has lambdas, so Spark makes these columns outside of whole-stage code, in
    methods that it splits.
    """
    read = lambda variant, fields: F.try_variant_get(variant, "$", f"struct<{fields}>")
    s, e, mine, its = map(F.col, ("s", "e", "mine", "its"))
    rows = queries.select("query_id", read(F.col("source"), SOURCE).alias("s"), "target_candidates")
    rows = rows.select("query_id", _fields(s).alias("s"), _box(s).alias("own"), _size(s).alias("size"), "target_candidates").withColumn("mine", _parts(s))
    # for an inner explode Spark first filters by the array's size, and makes the array twice where it is made in the same plan
    rows = rows.select("query_id", "s", "own", "size", "mine", F.posexplode_outer("target_candidates").alias("pos", "c")).where("pos is not null")
    rows = rows.select("query_id", "s", "own", "size", "mine", "pos", "c.candidate_id", "c.bbox", read(F.col("c.metadata"), ELEMENT).alias("e"))
    rows = rows.withColumn("e", _fields(e)).withColumn("its", _parts(e))
    rows = rows.withColumn("alike", F.struct(*(X.jaccard(mine[n], its[n], distinct=True).alias(n) for n in ("words", "ids", "above"))))
    made = _features(s, F.col("own"), F.col("size"), e, F.col("bbox"), F.col("alike"))
    return rows.select("query_id", "pos", "candidate_id", *(f.alias(n) for n, f in made.items()))


def _features(mine: Column, own: Column, size: Column, its: Column, bbox: Column, alike: Column) -> dict[str, Column]:
    """The features of WEIGHTS of a source and a candidate (_fields() of both, boxes, and how alike their parts are)."""
    box = {n: F.try_divide(bbox[n], size["wh"[i % 2]]) for i, n in enumerate(CORNERS)}
    middle = lambda b: ((b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2)
    (sx, sy), (cx, cy) = middle(own), middle(box)
    known = F.coalesce(sx, sy, cx, cy).isNotNull() & sx.isNotNull() & cx.isNotNull()
    return {
        "text_overlap": _both(mine["text"], its["text"], alike["words"]),
        "text_likeness": _both(mine["text"], its["text"], X.edit_likeness(mine["text"], its["text"])),
        "id_overlap": _both(mine["resource_id"], its["resource_id"], alike["ids"]),
        "same_class": _both(mine["class"], its["class"], X.same(mine["class"], its["class"])),
        "parent_overlap": _both(mine["parent"], its["parent"], alike["above"]),
        **{f: X.same(mine[f], its[f]) for f in FLAGS},
        "box_overlap": F.when(known, X.overlap_ratio(own, box)).otherwise(0.0),
        "same_region": F.when(known, X.same(X.region(*(own[n] for n in CORNERS)), X.region(*box.values()))).otherwise(0.0),
        "distance": F.when(known, X.distance(F.array(sx, sy), F.array(cx, cy))).otherwise(0.0),
    }


class StructuredRanker:
    """A matcher: the candidate of the largest weighted sum of pair features."""

    def __init__(self, weights: dict[str, float] | None = None) -> None:
        self.weights = WEIGHTS if weights is None else weights

    def scored(self, queries: DataFrame) -> DataFrame:
        return pair_features(queries).select("query_id", "pos", "candidate_id", rank.linear_score(self.weights).alias("score"))

    def predict(self, queries: DataFrame) -> DataFrame:
        """query_id, selected_candidate_id and scores of every query that has candidates."""
        return rank.predictions(self.scored(queries))

    __call__ = predict
