"""Target relocation analytics and corpus operators on Spark DataFrames."""

from waymark.sources.rows import Candidate, Prediction, Query

__all__ = ["Candidate", "Prediction", "Query"]
