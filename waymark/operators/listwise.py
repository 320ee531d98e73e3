"""A linear reranker fitted to the relational losses: softmax over a query's candidates, and the hard-negative margin.

The loss of a query with a right candidate is log-sum-exp of its scores less the right one's score, plus
LAMBDA_MARGIN times max(0, MARGIN - right score + best other score). Its gradient is a sum over candidates, so a
step is one window and one sum, whose result (one number for each feature) is all that reaches the driver.
Candidates are written once in buckets of query_id, so that steps need no exchange; contributions are
rounded to whole numbers of 2^-24, so that the sums don't depend on the order of tasks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions.scoring import log_sum_exp, softmax
from waymark.operators.rank import top
from waymark.sources.scratch import save_by

STEPS, RATE, MARGIN, LAMBDA_MARGIN = 12, 4.0, 0.5, 0.25
UNIT = 1 << 24


class Scale(NamedTuple):
    """A feature's range, which becomes 0 to 1."""

    name: str
    low: float
    high: float

    def column(self) -> Column:
        """Null and NaN count as the low end."""
        x = F.col(self.name).cast("double")
        known = x.isNotNull() & ~F.isnan(x)
        return F.when(known, (x - self.low) / (self.high - self.low)).otherwise(0.0) if self.high > self.low else F.lit(0.0)


class Model(NamedTuple):
    scales: list[Scale]
    weights: list[float]
    #: Mean loss before each step.
    losses: list[float]

    def score(self) -> Column:
        total = F.lit(0.0)
        for scale, w in zip(self.scales, self.weights, strict=True):
            total = total + scale.column() * w
        return total

    def exported(self, spark: SparkSession) -> DataFrame:
        """feature, low, high and weight."""
        return spark.createDataFrame([(*s, float(w)) for s, w in zip(self.scales, self.weights, strict=True)], "feature string, low double, high double, weight double")


def scales_of(rows: DataFrame, features: list[str]) -> list[Scale]:
    clean = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features]
    ends = rows.agg(*(F.min(c).alias(f"low{i}") for i, c in enumerate(clean)), *(F.max(c).alias(f"high{i}") for i, c in enumerate(clean))).first()
    return [Scale(f, ends[f"low{i}"] or 0.0, ends[f"high{i}"] or 0.0) for i, f in enumerate(features)]


def pulls(scored: DataFrame, margin: float = MARGIN, lambda_margin: float = LAMBDA_MARGIN) -> DataFrame:
    """Adds pull, the loss's derivative by each candidate's score, and loss (on the right candidate's row) to (query_id, pos, gold, score).

    Null for candidates of queries that have no right one.
    """
    query, score = Window.partitionBy("query_id"), F.col("score")
    right = F.col("gold") == 1
    # the hard negative: the best other candidate, the first of equals
    place = F.row_number().over(Window.partitionBy("query_id", "gold").orderBy(F.desc("score"), F.asc("pos")))
    gold_score, other_score = F.max(F.when(right, score)).over(query), F.max(F.when(~right, score)).over(query)
    met = scored.withColumns({"place": place, "p": softmax(score), "lse": log_sum_exp(score), "gold_score": gold_score, "other_score": other_score})
    short = F.coalesce(margin - F.col("gold_score") + F.col("other_score"), F.lit(0.0))
    active = F.when(short > 0, lambda_margin).otherwise(0.0)
    hard = F.when(right, -active).when(F.col("place") == 1, active).otherwise(0.0)
    pull = F.col("p") - F.when(right, 1.0).otherwise(0.0) + hard
    known = F.col("gold_score").isNotNull()
    loss = F.col("lse") - score + lambda_margin * F.greatest(short, F.lit(0.0))
    return met.withColumns({"pull": F.when(known, pull), "loss": F.when(known & right, loss)}).drop("place", "p", "lse", "gold_score", "other_score")


def step(scored: DataFrame, columns: list[Column]) -> tuple[list[float], float]:
    """The mean gradient by each column's weight, and the mean loss, of scored candidates."""
    units = lambda x: F.sum(F.floor(x * UNIT + 0.5))
    sums = pulls(scored).agg(*(units(F.col("pull") * c).alias(f"g{i}") for i, c in enumerate(columns)), units(F.col("loss")).alias("loss"), F.count("loss").alias("n")).first()
    n = max(1, sums["n"])
    return [float(sums[f"g{i}"] or 0) / UNIT / n for i in range(len(columns))], float(sums["loss"] or 0) / UNIT / n


def fit(candidates: DataFrame, features: list[str], steps: int = STEPS, rate: float = RATE) -> Model:
    """Weights for candidates (query_id, pos, gold and features), gold being 1 for a query's right candidate, else 0; from weights of 0."""
    model = Model(scales_of(candidates, features), [0.0] * len(features), [])
    scaled = [s.column().alias(f"x{i}") for i, s in enumerate(model.scales)]
    rows = save_by(candidates.select("query_id", "pos", F.col("gold").cast("int").alias("gold"), *scaled), "query_id")
    columns = [F.col(f"x{i}") for i in range(len(features))]
    for _ in range(steps):
        total = F.lit(0.0)
        for c, w in zip(columns, model.weights, strict=True):
            total = total + c * w
        gradient, loss = step(rows.withColumn("score", total), columns)
        model = Model(model.scales, [w - rate * g for w, g in zip(model.weights, gradient, strict=True)], [*model.losses, loss])
    return model


def rank(candidates: DataFrame, model: Model) -> DataFrame:
    """query_id, candidate_id and score of each query's best candidate (ties to the first)."""
    return top(candidates.withColumn("score", model.score())).select("query_id", "candidate_id", "score")
