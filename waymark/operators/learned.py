"""Learned rankers: pointwise classifiers whose probability ranks a query's candidates."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.metrics import split_of
from waymark.operators.rank import top
from waymark.sources.scratch import save

SEED = 11
#: Rows that a task trains on, about.
TASK_ROWS = 200_000


def estimator(kind: str, n_features: int):
    common = {"featuresCol": "x", "labelCol": "label"}
    if kind == "gbt":
        return GBTClassifier(maxIter=8, maxDepth=4, seed=SEED, **common)
    if kind == "logistic":
        return LogisticRegression(maxIter=30, regParam=0.001, **common)
    return MultilayerPerceptronClassifier(layers=[n_features, 8, 2], maxIter=40, seed=SEED, **common)


def rank(candidates: DataFrame, features: list[str], kind: str) -> DataFrame:
    """Fit on the train split of candidates with label (1 for gold), rank all: query_id, candidate_id, score of the best."""
    rows = save(candidates.select("query_id", "pos", "candidate_id", "label", *features))  # what makes candidates runs once
    scaler = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True)])
    train = rows.where(split_of(F.col("query_id")) == "train")
    scaled = scaler.fit(train)
    model = estimator(kind, len(features)).fit(dealt(scaled.transform(train), train.count()).select("x", "label"))
    scored = model.transform(scaled.transform(rows)).withColumn("score", vector_to_array("probability")[1])
    return top(scored.select("query_id", "pos", "candidate_id", "score")).select("query_id", "candidate_id", F.round("score", 6).alias("score"))


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """n rows in so many tasks as their number asks for: files and shuffles of few different numbers say little about the size of rows that MLlib keeps."""
    return rows.repartition(n // TASK_ROWS + 1, "query_id", "pos")
