"""Reproducible bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import schema as S


def sample_key(key: str | Column, seed: int) -> Column:
    """Hash that orders rows pseudo-randomly, independent of partitioning."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def bounded_sample(df: DataFrame, n: int, key: str = S.ROW_ORD, seed: int = 0) -> DataFrame:
    """At most ``n`` rows: exactly ``min(n, rows)``, the same ones on every run.

    Planned as a top-n per task and one merge of those, so nothing but ``n`` rows per task moves.
    """
    return df.orderBy(sample_key(key, seed), key).limit(n)
