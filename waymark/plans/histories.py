"""Queries over retrieved history: each vector is a recorded element, its id the time of recording, its label the outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import retrieval
from waymark.plans.registry import query
from waymark.sources import bindings as B

#: Queries are the vectors whose id divides by ASKED; so many earlier rows are retrieved for each.
ASKED, TAKEN = 50, 5


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("at"), F.col("embedding").alias("e"), F.col("label").alias("outcome"))


@query(f"""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS candidate, a.label AS own, b.label AS outcome, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id WHERE a.vec_id % {ASKED} = 0),
best AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate) <= {TAKEN})
SELECT query_id, count(*) AS n_retrieved, string_agg(CAST(candidate AS VARCHAR), ',' ORDER BY score DESC, candidate) AS candidates, max(score) AS best, round(sum(CAST(round(score * 1000000) AS BIGINT)) / (count(*) * 1e6), 6) AS mean,
  round(avg(CASE WHEN own = outcome THEN 1e0 ELSE 0e0 END), 6) AS agreement FROM best GROUP BY query_id""")
def history_retrieved(spark: SparkSession, d: str) -> DataFrame:
    """History features of the earlier elements most like each query, found exactly through the index."""
    rows = _vectors(spark, d)
    found = retrieval.search(retrieval.build(rows), rows.where(F.col("id") % ASKED == 0), TAKEN, exact=True, earlier=True)
    features = retrieval.history_features(found, rows.select("id", "outcome"))
    named = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate"))), lambda x: x["candidate"].cast("string")), ",").alias("candidates"))
    return features.join(named, "query_id").select("query_id", "n_retrieved", "candidates", "best", F.round("mean", 6).alias("mean"), F.round("agreement", 6).alias("agreement"))


@query()
def history_recall(spark: SparkSession, d: str) -> DataFrame:
    """What a search of so many cells as calibrate() says finds of the exact answer, for each query."""
    rows = _vectors(spark, d)
    index = retrieval.build(rows)
    asked = rows.where(F.col("id") % ASKED == 0)
    found = retrieval.search(index, asked, TAKEN, retrieval.calibrate(index, asked, TAKEN, earlier=True), earlier=True)
    return retrieval.recall(found, retrieval.search(index, asked, TAKEN, exact=True, earlier=True))
