"""Writing clean tables and flagged rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import schema as S


def write_clean(clean: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store a clean table as Parquet, partitioned by year and month.

    Rows are range-partitioned by time before writing: tasks stay even when one month holds
    most rows, and every file covers a narrow time span, so row-group statistics prune too.
    """
    (
        clean.repartitionByRange(S.TIME)
        .sortWithinPartitions("year", "month", S.TIME)
        .write.mode(mode)
        .partitionBy("year", "month")
        .parquet(path)
    )


def write_rows(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", compression: str | None = None) -> None:
    """Store result rows as Parquet, or as CSV with a header for people to download."""
    options = {"compression": compression} if compression else {}
    writer = df.write.mode(mode).options(**options)
    if fmt != "csv":
        writer.format(fmt).save(path)
        return
    flat = df.select(
        *[
            F.col(f.name).cast("string").alias(f.name)
            if isinstance(f.dataType, T.TimestampNTZType)
            else F.col(f.name)
            for f in df.schema
        ]
    )
    flat.write.mode(mode).options(**options).option("header", True).option("escape", '"').csv(path)
