"""Truth table of the accuracy metric, properties of ranking and losses, and files."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import features as X
from waymark.functions.report import format_percent
from waymark.functions.scoring import softmax
from waymark.operators import baselines, losses, metrics, nearest, rank
from waymark.sources import schema

Q = "query_id string, ord long, gold string"
P = "query_id string, selected string"


@pytest.mark.parametrize(
    ("queries", "predictions", "expected"),
    [
        ([], [], 0.0),
        ([("q", 0, "a")], [("q", "a")], 1.0),
        ([("q", 0, "a")], [("q", "b")], 0.0),
        ([("q", 0, "a")], [("q", None)], 0.0),
        ([("q", 0, None)], [("q", "a")], 0.0),
        ([("q", 0, "")], [("q", "")], 1.0),
        ([("q", 0, "a")], [("r", "a")], 0.0),
        ([("q", 0, "a"), ("r", 1, "b")], [("q", "a")], 1.0),
        ([("q", 0, "a"), ("q", 1, "b")], [("q", "b")], 1.0),
        ([("q", 0, "a"), ("q", 1, None)], [("q", "a")], 0.0),
        ([("q", 0, "a")], [("q", "a"), ("q", "b")], 0.5),
        ([("q", 0, "a")], [("q", "a")] * 2, 1.0),
    ],
)
def test_top1_code(spark, queries, predictions, expected):
    row = metrics.top1_code(spark.createDataFrame(queries, Q), spark.createDataFrame(predictions, P)).first()
    assert row["top1"] == expected


def test_top1_doc_counts_missing_and_absent(spark):
    queries = spark.createDataFrame([("q", 0, "a"), ("r", 1, "b"), ("s", 2, None)], Q)
    made = spark.createDataFrame([("q", "a"), ("s", None)], P)
    row = metrics.top1_doc(queries, made).first()
    assert (row["correct"], row["total"]) == (2, 3)


def test_safety_counts_part_all_predictions(spark):
    queries = spark.createDataFrame([(f"q{i}", i, "a" if i % 3 else None) for i in range(12)], Q)
    made = spark.createDataFrame([(f"q{i}", [None, "a", "b"][i % 4 % 3]) for i in range(12)], P)
    c = metrics.safety_counts(queries, made).first()
    assert c["false_positive"] + c["abstain_right"] == c["gold_null"]
    assert c["correct"] + c["wrong_target"] + c["abstain_wrong"] == c["gold_concrete"]


def test_percent(spark):
    values = [0.767008, 0.00125, 1.0, 0.0, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(format_percent("v")).collect()]
    assert got == [None if v is None else f"{100.0 * v:.2f}%" for v in values]
    assert got[0] == "76.70%"


CANDIDATES = [("q", 0, "x", 1000.0), ("q", 1, "y", 1000.0), ("q", 2, "z", float("nan")), ("r", 0, "x", None), ("r", 1, "y", -5.0)]
C = "query_id string, pos int, candidate_id string, score double"


def test_softmax_is_stable_and_sums_to_one(spark):
    rows = spark.createDataFrame([c for c in CANDIDATES if c[3] is not None and not math.isnan(c[3])], C)
    got = rows.withColumn("p", softmax(F.col("score"))).groupBy("query_id").agg(F.sum("p").alias("s")).collect()
    assert {r["query_id"]: r["s"] for r in got} == {"q": 1.0, "r": 1.0}


def test_top_breaks_ties_by_position_and_ranks_nan_last(spark):
    rows = spark.createDataFrame(CANDIDATES, C)
    assert {r["query_id"]: r["candidate_id"] for r in rank.top(rows.repartition(3)).collect()} == {"q": "x", "r": "y"}
    assert rank.top(rows, 5).where("candidate_id = 'z'").first()["rank"] == 3


def test_abstains_below_null_score_and_within_margin(spark):
    rows = spark.createDataFrame([("a", 0, "x", 5.0), ("b", 0, "x", 1.0), ("c", 0, "x", 5.0), ("c", 1, "y", 4.99)], C)
    queries = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "query_id string")
    got = {r["query_id"]: r["selected"] for r in rank.select_or_abstain(rows, queries, 2.0, 0.05).collect()}
    assert got == {"a": "x", "b": None, "c": None, "d": None}


def test_losses(spark):
    rows = spark.createDataFrame([("q", 0, "x", 2.0, "x"), ("q", 1, "y", 1.5, "x"), ("r", 0, "x", 1.0, "x")], C + ", gold string")
    got = {r["query_id"]: r["loss"] for r in losses.candidate_loss(rows).collect()}
    assert got["q"] == pytest.approx(math.log(1 + math.exp(-0.5))) and got["r"] == 0
    assert {r["query_id"]: r["loss"] for r in losses.margin_loss(rows, 1.0).collect()} == {"q": 0.5, "r": 0.0}
    assert losses.hard_negative(rows).first()["candidate_id"] == "y"
    masks = spark.createDataFrame([("q", [0.5, 0.25], [1.0, 0.0])], "query_id string, predicted array<double>, gold_mask array<double>")
    assert losses.patch_loss(masks).first()["loss"] == pytest.approx(-(math.log(0.5) + math.log(0.75)) / 2)


def test_features_of_empty_and_unknown(spark):
    row = spark.createDataFrame([(None, "a b", [], [])], "t string, u string, e array<string>, f array<string>")
    got = row.select(X.same(F.col("t"), F.col("u")), X.jaccard(F.col("e"), F.col("f")), X.text_overlap(F.col("u"), F.col("u")), X.edit_likeness(F.lit(""), F.lit(""))).first()
    assert tuple(got) == (0.0, 0.0, 1.0, 1.0)


def test_coordinate_prefers_nearest_center(spark):
    box = "struct<x0: double, y0: double, x1: double, y1: double>"
    candidates = spark.createDataFrame([("q", 0, "big", (0.0, 0.0, 1.0, 1.0)), ("q", 1, "small", (0.1, 0.1, 0.3, 0.3)), ("q", 2, "off", (0.8, 0.8, 0.9, 0.9))], f"query_id string, pos int, candidate_id string, bbox {box}")
    points = spark.createDataFrame([("q", 0.2, 0.2), ("r", 0.0, 0.0)], "query_id string, x double, y double")
    assert {r[0]: r[1] for r in baselines.coordinate(points, candidates).collect()} == {"q": "small", "r": None}


def test_ambiguous_path_selects_nothing(spark):
    sources = spark.createDataFrame([("q", 1), ("r", 1), ("s", 1)], "query_id string, path int")
    candidates = spark.createDataFrame([("q", 1, "a"), ("r", 1, "a"), ("r", 1, "b"), ("s", 2, "a")], "query_id string, path int, candidate_id string")
    assert {r[0]: r[1] for r in baselines.exact_tree(sources, candidates).collect()} == {"q": "a", "r": None, "s": None}


def test_jsonl_reads_boxes_and_rejects_garbage(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"query_id": "q1", "source": {"point": [1, 2]}, "target_candidates": [{"candidate_id": "target-1", "bbox": [0.0, 1.0, 2.0, 3.0], "metadata": {}}], "gold_candidate_id": null}\n')
    row = schema.load_queries(spark, str(path)).first()
    assert tuple(row["target_candidates"][0]["bbox"]) == (0.0, 1.0, 2.0, 3.0) and row["gold_kind"] == "NULL"
    path.write_text("{oops\n")
    with pytest.raises(Exception):  # noqa: B017
        schema.load_queries(spark, str(path)).collect()


def test_validation_finds_each_violation(spark):
    queries = spark.createDataFrame([("q", 0, "a"), ("q", 1, "a"), ("r", 2, "zzz")], Q)
    candidates = spark.createDataFrame([("q", "a"), ("q", "a"), ("r", "b")], "query_id string, candidate_id string")
    made = spark.createDataFrame([("q", "b"), ("x", None)], P)
    got = {tuple(r) for r in schema.validate_queries(queries, candidates, made).collect()}
    assert got == {("q", "duplicate_candidate"), ("q", "duplicate_query"), ("r", "gold_not_candidate"), ("q", "selected_not_candidate"), ("x", "unknown_query")}


@pytest.mark.parametrize("block", [4096, 3])
def test_nearest_of_all_other_vectors(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(60, [0.0] * 4), (61, None)]
    rows[59] = (59, rows[0][1])  # the best of the first comes last
    df = spark.createDataFrame(rows, "id long, e array<double>").repartition(3)
    asked = df.where("id % 10 = 0")
    got = {r["query_id"]: (r["candidate"], r["score"]) for r in nearest.nearest(df, asked, block).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows[:60]}
    want = {i: min((-round(float(unit[i] @ unit[k]), 6), k) for k in unit if k != i) for i in range(0, 60, 10)}
    assert got == {i: (k, -s) for i, (s, k) in want.items()} and got[0] == (59, 1.0)
    assert nearest.nearest(df, df.where("false")).count() == 0
