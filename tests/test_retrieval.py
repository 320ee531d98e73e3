"""Retrieved history against all pairs, and what an index of clustered vectors finds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import retrieval


def vectors(seed, n, width=8, clusters=None):
    rng = np.random.default_rng(seed)
    if clusters:
        base = rng.normal(size=(clusters, width)) * 4
        e = base[rng.integers(0, clusters, n)] + rng.normal(size=(n, width))
    else:
        e = rng.normal(size=(n, width))
    rows = [(i, (i * 37) % n, [float(x) for x in v]) for i, v in enumerate(e)]
    rows += [(n + i, rows[i][1], list(rows[i][2])) for i in range(10)]  # copies: ties
    rows += [(9000, 5, None), (9001, 5, [0.0] * width), (9002, 5, [float("nan")] * width), (9003, 5, [1.0]), (9004, None, rows[3][2]), (9005, 5, [None] + [1.0] * (width - 1))]
    return rows


KIND = "id long, at long, e array<double>"


def brute(rows, queries, k, earlier):
    width = max(len(r[2]) for r in rows if r[2])
    good = [r for r in rows if r[2] and len(r[2]) == width and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2])]
    unit = {r[0]: np.array(r[2]) / np.sqrt((np.array(r[2]) ** 2).sum()) for r in good}
    out = {}
    for q in queries:
        if q[0] not in unit:
            continue
        met = [(-round(float(unit[q[0]] @ unit[r[0]]), 6), r[0]) for r in good if r[0] != q[0] and (not earlier or (r[1] is not None and q[1] is not None and r[1] < q[1]))]
        out |= {(q[0], i): (c, -s) for i, (s, c) in enumerate(sorted(met)[:k], 1)}
    return out


@pytest.mark.parametrize(("clusters", "earlier", "cells"), [(None, False, None), (12, True, 20), (3, True, 1)])
def test_exact_search_equals_all_pairs(spark, monkeypatch, clusters, earlier, cells):
    monkeypatch.setattr(retrieval, "ROWS_BLOCK", 50)  # cells in several blocks
    monkeypatch.setattr(retrieval, "QUERIES_BLOCK", 7)
    rows = vectors(3, 400, clusters=clusters)
    df = spark.createDataFrame(rows, KIND).repartition(3)
    asked = [r for r in rows if r[0] % 9 == 0 or r[0] >= 9000]
    found = retrieval.search(retrieval.build(df, cells), spark.createDataFrame(asked, KIND), 6, probes=2, exact=True, earlier=earlier)
    got = {(r["query_id"], r["rank"]): (r["candidate"], r["score"]) for r in found.collect()}
    want = brute(rows, asked, 6, earlier)
    assert got.keys() == want.keys()
    for key, (candidate, score) in want.items():
        assert got[key][1] == pytest.approx(score, abs=2e-6)
        assert got[key][0] == candidate or abs(got[key][1] - score) < 2e-6  # rounding may part equal scores


def test_few_cells_find_most_of_clustered_vectors(spark):
    rows = spark.createDataFrame(vectors(5, 3000, width=16, clusters=40), KIND)
    index = retrieval.build(rows, 40)
    asked = rows.where("id % 50 = 0")
    probes = retrieval.calibrate(index, asked, 5)
    assert probes <= 8
    right = retrieval.search(index, asked, 5, exact=True)
    counts = retrieval.recall(retrieval.search(index, asked, 5, probes=probes), right).agg(F.sum("wanted").alias("wanted"), F.sum("met").alias("met")).first()
    assert counts["wanted"] == 5 * asked.where("id < 9000").count() and counts["met"] >= 0.9 * counts["wanted"]


def test_vectors_without_clusters_are_found_too(spark):
    rows = spark.createDataFrame(vectors(6, 1500, width=32), KIND)
    index = retrieval.build(rows)
    asked = rows.where("id % 20 = 0")
    found = retrieval.search(index, asked, 5, probes=retrieval.calibrate(index, asked, 5))
    counts = retrieval.recall(found, retrieval.search(index, asked, 5, exact=True)).agg(F.sum("met") / F.sum("wanted")).first()[0]
    assert counts >= 0.9


def test_history_features_and_nothing(spark):
    assert retrieval.build(spark.createDataFrame([(1, 1, None)], KIND)) is None
    found = spark.createDataFrame([(1, 1, 2, 0.5), (1, 2, 3, 0.25), (4, 1, 1, 1.0)], "query_id long, rank int, candidate long, score double")
    outcomes = spark.createDataFrame([(1, 7), (2, 7), (3, None), (4, None)], "id long, outcome int")
    got = {r["query_id"]: tuple(r)[1:] for r in retrieval.history_features(found, outcomes).collect()}
    assert got == {1: (2, 0.5, 0.375, 0.5), 4: (1, 1.0, 1.0, 0.0)}


def test_rows_are_in_one_cell_each(spark):
    rows = spark.createDataFrame(vectors(7, 500), KIND)
    index = retrieval.build(rows, 9)
    assert index.rows.count() == index.rows.select("id").distinct().count() == 511 and index.counts.sum() == 511
    assert random.Random(1).choice(index.centers).shape == (8,)


def test_a_block_takes_little_memory():
    """matrices of a whole block of queries and rows took some hundred MB of each worker."""
    import tracemalloc

    import pyarrow as pa

    table = lambda n: pa.table({"id": np.arange(n), "at": np.zeros(n, np.int64), "e": pa.array(list(np.random.default_rng(n).normal(size=(n, 8))))})
    rows, queries = table(8192), table(1024)
    tracemalloc.start()
    found = retrieval._meet(1, False)(rows, queries)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 1024 and peak < 64e6
