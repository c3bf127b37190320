"""Interquartile-range anomalies, overall or within groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions.attach import by_group, with_row
from tidewatch.functions.quantiles import exact_quantiles
from tidewatch.functions.scalars import round_to

TABLE_COLUMNS = [
    S.TIME, "day_name", "hour", S.TARGET, "anomaly_type", "lower_limit", "upper_limit",
    "distance_outside_limit", "weather_main", "holiday",
]


def iqr_limits(
    df: DataFrame, keys=tuple(S.ANOMALY_GROUP), multiplier: float = S.IQR_MULTIPLIER,
    target: str = S.TARGET, *, bound: int | None = None, distributed=True,
) -> DataFrame:
    """Lower and upper limit per group, from exact quartiles."""
    found = exact_quantiles(
        df, target, [0.25, 0.75], keys, bound=bound, distributed=distributed
    )
    q1, q3 = F.col("q")[0], F.col("q")[1]
    return found.select(
        *keys,
        (q1 - multiplier * (q3 - q1)).alias("lower_limit"),
        (q3 + multiplier * (q3 - q1)).alias("upper_limit"),
    )


def flag_anomalies(
    df: DataFrame, keys=tuple(S.ANOMALY_GROUP), multiplier: float = S.IQR_MULTIPLIER,
    target: str = S.TARGET, *, bound: int | None = None, distributed=True,
) -> DataFrame:
    """Every row with the limits of its group and its class: High, Low or Normal.

    No keys means one limit for all rows. Rows with a null key have no limits and are Normal.
    The limits come back to the rows by a broadcast of at most one row per calendar group;
    a window over the group would shuffle and sort every row.
    """
    keys = list(keys)
    limits = iqr_limits(df, keys, multiplier, target, bound=bound, distributed=distributed)
    out = by_group(df, limits, keys, bound=bound) if keys else with_row(df, limits)
    value = F.col(target)
    high, low = value > F.col("upper_limit"), value < F.col("lower_limit")
    return out.withColumns({
        "is_anomaly": F.coalesce(high | low, F.lit(False)),
        "anomaly_type": F.when(high, "High").when(low, "Low").otherwise("Normal"),
    })


def anomaly_table(flagged: DataFrame, n: int | None = None, target: str = S.TARGET) -> DataFrame:
    """Flagged rows, furthest outside their limit first (distance as shown, then time).

    ``n`` keeps the first rows for display, as a bounded top-n.
    """
    value = F.col(target)
    distance = (
        F.greatest(value - F.col("upper_limit"), F.lit(0.0))
        + F.greatest(F.col("lower_limit") - value, F.lit(0.0))
    )
    table = (
        flagged.where("is_anomaly")
        .withColumn("distance_outside_limit", round_to(distance))
        .withColumns({c: round_to(c) for c in ("lower_limit", "upper_limit")})
        .select(*[c for c in TABLE_COLUMNS])
        .orderBy(F.desc("distance_outside_limit"), S.TIME)
    )
    return table if n is None else table.limit(n)


def anomaly_counts(flagged: DataFrame) -> DataFrame:
    """Rows, flagged rows, both directions, and the flagged share in percent."""
    share = F.avg(F.col("is_anomaly").cast("double"))
    return flagged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_anomaly").alias("flagged"),
        F.count_if(F.col("anomaly_type") == "High").alias("high"),
        F.count_if(F.col("anomaly_type") == "Low").alias("low"),
        F.coalesce(round_to(F.lit(100.0) * share, 2), F.lit(0.0)).alias("percent"),
    )


def anomalies_by_hour(flagged: DataFrame) -> DataFrame:
    """Flagged rows per hour of day and direction."""
    return (
        flagged.where("is_anomaly").groupBy("hour", "anomaly_type")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def anomaly_series(flagged: DataFrame, kind: str | None = None, target: str = S.TARGET) -> DataFrame:
    """Time, value and class of every row, or of one class."""
    series = flagged.select(S.TIME, target, "anomaly_type")
    return series if kind is None else series.where(F.col("anomaly_type") == kind)
