"""Bringing small results back to the rows they were computed from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.session import cut_lineage

#: Bytes counted for a value: an array's length is not in its type, so the longest in use.
_ARRAY_BYTES, _TEXT_BYTES, _VALUE_BYTES = 2_048, 128, 16


def row_bytes(df: DataFrame) -> int:
    """An upper estimate of the memory one row takes."""
    kinds = [f.dataType.typeName() for f in df.schema]
    return 32 + sum(
        _ARRAY_BYTES if k in ("array", "map", "struct") else _TEXT_BYTES if k in ("string", "binary") else _VALUE_BYTES
        for k in kinds
    )


def with_row(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row table on every row.

    The table becomes a single scalar subquery: it runs once, is planned once, and its fields
    are ordinary columns afterwards.
    """
    names = table.columns
    row = table.select(F.struct(*names).alias("row")).scalar()
    return df.withColumn("__row", row).select(
        *df.columns, *[F.col("__row")[c].alias(c) for c in names]
    )


def by_group(
    df: DataFrame, groups: DataFrame, keys, *, null_safe: bool = False, how: str = "left",
    bound: int | None = None,
) -> DataFrame:
    """Join per-group columns back to ``df``, keeping the column order of ``df``.

    ``groups`` holds one row per key. It is broadcast if its size in bytes is within
    ``S.MAX_BROADCAST_BYTES``: rows bounded by the calendar domain of the keys or by ``bound``,
    the caller's proof for other keys, times the width of a row. Without such a bound the group
    table is written first and its rows are counted, so the rows of ``df`` are shuffled only
    where the groups really are many. That join leaves skewed keys to adaptive execution,
    which needs an exchange right below both sides; a null-safe condition brings that about,
    as it cannot reuse the partitioning of the aggregate that made ``groups``.
    """
    limit = bound if bound is not None else S.group_bound(keys)
    if limit is None or limit * row_bytes(groups) > S.MAX_BROADCAST_BYTES:
        groups = cut_lineage(groups)
        limit = groups.count()
    extra = [c for c in groups.columns if c not in keys]
    renamed = groups.select(*[F.col(k).alias(f"__key_{k}") for k in keys], *extra)
    if limit * row_bytes(groups) <= S.MAX_BROADCAST_BYTES:
        renamed = F.broadcast(renamed)
    elif not null_safe:
        renamed = renamed.dropna(subset=[f"__key_{k}" for k in keys])
        null_safe = True
    condition = None
    for key in keys:
        left, right = F.col(key), F.col(f"__key_{key}")
        term = left.eqNullSafe(right) if null_safe else left == right
        condition = term if condition is None else condition & term
    return df.join(renamed, condition, how).select(*df.columns, *extra)
