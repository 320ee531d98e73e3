"""Training losses of ranked candidates; input: query_id, candidate_id, pos, score, gold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.features import inside
from waymark.functions.scoring import binary_cross_entropy, log_sum_exp, softmax
from waymark.operators.rank import top


def candidate_loss(scored: DataFrame) -> DataFrame:
    """-log softmax of the gold candidate's score, for queries whose gold is a candidate."""
    lost = scored.withColumn("loss", log_sum_exp(F.col("score")) - F.col("score"))
    return lost.where("candidate_id = gold").select("query_id", "loss")


def hard_negative(scored: DataFrame) -> DataFrame:
    """The best-scored candidate that is not the gold one."""
    return top(scored.where("gold is not null and candidate_id <> gold")).select("query_id", "candidate_id", "score")


def margin_loss(scored: DataFrame, margin: float) -> DataFrame:
    """max(0, margin - gold's score + best other score); 0 without others."""
    both = scored.where("gold is not null").groupBy("query_id").agg(
        F.max(F.when(F.col("candidate_id") == F.col("gold"), F.col("score"))).alias("own"),
        F.max(F.when(F.col("candidate_id") != F.col("gold"), F.col("score"))).alias("other"),
    )
    loss = F.when(F.col("other").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), margin - F.col("own") + F.col("other")))
    return both.where("own is not null").select("query_id", loss.alias("loss"))


def patch_masks(scored: DataFrame, cells: int) -> DataFrame:
    """query_id, predicted and gold_mask (arrays, row by row) over cells * cells patches of a screen of size 1.

    scored has bbox besides. A patch belongs to a box that holds its center. What is predicted for a patch is the
    probability (softmax) of the candidates whose boxes hold it, between 0.01 and 0.99; queries without a gold candidate have no mask.
    """
    weighed = scored.withColumn("p", softmax(F.col("score")))
    centers = [((x + 0.5) / cells, (y + 0.5) / cells) for y in range(cells) for x in range(cells)]
    inside_of = lambda x, y: inside(F.lit(x), F.lit(y), F.col("bbox"))
    right = F.col("candidate_id") == F.col("gold")
    sums = weighed.groupBy("query_id").agg(
        F.count_if(right).alias("n"),
        F.array(*(F.sum(F.when(inside_of(x, y), F.col("p")).otherwise(0.0)) for x, y in centers)).alias("heat"),
        F.array(*(F.max(F.when(inside_of(x, y) & right, 1.0).otherwise(0.0)) for x, y in centers)).alias("gold_mask"),
    )
    return sums.where("n > 0").select("query_id", F.transform("heat", lambda h: 0.01 + 0.98 * F.least(h, F.lit(1.0))).alias("predicted"), "gold_mask")


def patch_loss(masks: DataFrame) -> DataFrame:
    """Mean binary cross-entropy of predicted and gold patch masks (arrays)."""
    return masks.select("query_id", binary_cross_entropy(F.col("predicted"), F.col("gold_mask")).alias("loss"))


def total_loss(candidate: DataFrame, patch: DataFrame, margin: DataFrame, lambda_patch: float, lambda_margin: float) -> DataFrame:
    """Weighted sum; a query without a patch or margin loss has 0 there."""
    named = [d.withColumnRenamed("loss", n) for d, n in ((candidate, "c"), (patch, "p"), (margin, "m"))]
    joined = named[0].join(named[1], "query_id", "left").join(named[2], "query_id", "left").na.fill(0.0, ["p", "m"])
    return joined.select("query_id", (F.col("c") + lambda_patch * F.col("p") + lambda_margin * F.col("m")).alias("loss"))
