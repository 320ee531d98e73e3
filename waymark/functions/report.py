"""Report cells."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def format_percent(value: pd.Series) -> pd.Series:
    """A ratio as a percentage of two decimals, rounded as the binary number is; for report rows only."""
    return value.map(lambda v: None if pd.isna(v) else f"{100.0 * float(v):.2f}%")
