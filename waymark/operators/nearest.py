"""The most alike of all other vectors for a set of query vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators import retrieval


def nearest(vectors: DataFrame, queries: DataFrame, block: int | None = None) -> DataFrame:
    """query_id, candidate and score (cosine, 6 decimals) of the best other vector, for queries that have one.

    Both have `id` (long) and `e` (array of numbers, all of one length). Queries and vectors are dealt into
    blocks (of at most `block` queries, about) which all meet in one shuffle; a block gives one row for each of its queries.
    Ties go to the least id; of vectors of one id the most alike counts. The work is the product of both sizes.
    """
    timeless = lambda df: df.select("id", F.lit(0).alias("at"), "e")
    index = retrieval.build(timeless(vectors), cells=1)
    if index is None:
        return queries.select(F.col("id").alias("query_id"), F.col("id").alias("candidate"), F.lit(0.0).alias("score")).where("false")
    found = retrieval.search(index, timeless(queries), 1, probes=1, queries_block=block)
    return found.select("query_id", "candidate", "score")
