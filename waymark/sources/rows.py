"""Constructors of rows as columns: a candidate, a query and a prediction in the types of their files."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.sources import schema


def _typed(value: Any, kind: T.DataType) -> Column:
    """A column or a Python value as a column of a type."""
    if isinstance(kind, T.VariantType):
        return value if isinstance(value, Column) else F.parse_json(F.lit(json.dumps(value)))
    if isinstance(kind, T.ArrayType) and isinstance(value, (list, tuple)):
        return F.array(*(_typed(v, kind.elementType) for v in value)).cast(kind)
    if isinstance(kind, T.MapType) and isinstance(value, dict):
        return F.create_map(*(F.lit(x) for item in value.items() for x in item)).cast(kind)
    if isinstance(value, Column):
        return value if isinstance(kind, T.StructType) else value.cast(kind)
    return F.lit(value).cast(kind)


def _row(kind: T.StructType, **values: Any) -> Column:
    return F.struct(*(_typed(values[f.name], f.dataType).alias(f.name) for f in kind))


def Candidate(candidate_id: Any, bbox: Any = None, metadata: Any = None) -> Column:  # noqa: N802  public names of the row types
    """A candidate: bbox is four corners or None, metadata a dict or a variant."""
    return _row(schema.CANDIDATE_FILE, candidate_id=candidate_id, bbox=bbox, metadata={} if metadata is None else metadata)


def Query(query_id: Any, source: Any, target_candidates: Any, gold_candidate_id: Any = None, metadata: Any = None) -> Column:  # noqa: N802
    """A query: source is a dict or a variant, target_candidates a list of Candidate columns or an array column."""
    return _row(schema.QUERY_FILE, query_id=query_id, source=source, target_candidates=target_candidates, gold_candidate_id=gold_candidate_id, metadata={} if metadata is None else metadata)


def Prediction(query_id: Any, selected_candidate_id: Any, scores: Any, metadata: Any = None) -> Column:  # noqa: N802
    """A prediction: scores is a dict or a map column by candidate id."""
    return _row(schema.PREDICTION_FILE, query_id=query_id, selected_candidate_id=selected_candidate_id, scores=scores, metadata={} if metadata is None else metadata)
