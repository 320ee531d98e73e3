"""Percentiles and numbers of different values from sketches, which are kept for parts of the data and merged.

A quantile's rank is off by at most RANK_ERROR of the rows (KLL of k = 200, with 99 % confidence), a number of
different values by about DISTINCT_ERROR of it (three standard errors of HyperLogLog with 4096 registers). Sketches
have a bounded size, whatever the number of rows; metrics.latency_summary() is the exact way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANK_ERROR, DISTINCT_ERROR = 0.0165, 0.049
K, LOG_REGISTERS = 200, 12


def sketched(rows: DataFrame, by: list[str], value: str, who: str) -> DataFrame:
    """A row for each part `by`: n (values that are not null) and sketches of value and who."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), K).alias("values"), F.hll_sketch_agg(who, LOG_REGISTERS).alias("who"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of larger parts from those of smaller ones."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("values").alias("values"), F.hll_union_agg("who").alias("who"))


def estimates(parts: DataFrame, by: list[str], share: float) -> DataFrame:
    """by, n, quantile (null without values) and n_who."""
    quantile = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("values", F.lit(share)))
    return parts.select(*by, "n", quantile.alias("quantile"), F.hll_sketch_estimate("who").alias("n_who"))
