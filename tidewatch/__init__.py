"""Observation analytics on Spark: DataFrame in, DataFrame out."""

from tidewatch.schema import MissingColumnsError, SourceNotFoundError

__all__ = ["MissingColumnsError", "SourceNotFoundError"]
