"""Probabilities and losses over a query's candidates as columns."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def of_query() -> WindowSpec:
    return Window.partitionBy("query_id")


def clean(score: Column) -> Column:
    """NaN as null, so that it ranks last."""
    return F.when(~F.isnan(score), score)


def log_sum_exp(score: Column, over: WindowSpec | None = None) -> Column:
    over = over or of_query()
    top = F.max(score).over(over)
    return top + F.log(F.sum(F.exp(score - top)).over(over))


def softmax(score: Column, over: WindowSpec | None = None) -> Column:
    """Shifted by the largest score, so that large scores don't overflow."""
    over = over or of_query()
    top = F.max(score).over(over)
    return F.exp(score - top) / F.sum(F.exp(score - top)).over(over)


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def binary_cross_entropy(predicted: Column, gold: Column) -> Column:
    """Mean over the elements of two arrays: predicted in (0, 1), gold 0 or 1."""
    each = F.zip_with(predicted, gold, lambda p, g: -(g * F.log(p) + (1 - g) * F.log(1 - p)))
    return F.try_divide(F.aggregate(each, F.lit(0.0), lambda a, x: a + x), F.size(predicted))
