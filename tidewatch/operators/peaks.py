"""Busiest hours, records and hour ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.operators.profiles import day_type_profile, high_traffic_periods, hourly_profile

TOP_COLUMNS = [S.TIME, "day_name", "hour", S.TARGET, "weather_main", "holiday"]


def top_hours(df: DataFrame, n: int = 5, *, distributed=True) -> DataFrame:
    """The ``n`` hours of day with the highest mean as shown (rounded); lowest hour on ties."""
    window = F.format_string("%02d:00 - %02d:59", "hour", "hour")
    return (
        hourly_profile(df, distributed=distributed)
        .orderBy(F.desc("mean"), "hour").limit(n)
        .select(window.alias("time_window"), "hour", "mean", "median", "observations")
    )


def top_observations(df: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` records with the highest volume; the earliest wins ties. A bounded top-n."""
    return df.orderBy(F.desc(S.TARGET), S.TIME).limit(n).select(*TOP_COLUMNS)


def peak_by_day_type(df: DataFrame) -> DataFrame:
    """Peak hour of weekdays and of weekends (from the 48-row hour by day type profile)."""
    order = Window.partitionBy("day_type").orderBy(F.desc("mean_traffic"), "hour")
    return (
        day_type_profile(df).where("day_type IS NOT NULL")
        .withColumn("__rn", F.row_number().over(order)).where("__rn = 1")
        .select("day_type", "hour", "mean_traffic")
    )


def hour_ranges(hours: DataFrame, extra: Column | None = None, hour: str = "hour") -> DataFrame:
    """Hours of day as text: runs of neighbours become one range, ``none`` for no hours.
    ``extra`` is a scalar to carry along.

    Runs share the difference between hour and rank. At most 24 distinct hours reach the
    window; nothing wraps at midnight.
    """
    distinct = hours.select(F.col(hour).alias("h")).where("h IS NOT NULL").distinct()
    runs = (
        distinct.withColumn("run", F.col("h") - F.row_number().over(Window.orderBy("h")))
        .groupBy("run").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    )
    pieces = F.transform(
        F.array_sort(F.collect_list(F.struct("a", "b"))),
        lambda r: F.format_string("%02d:00-%02d:59", r["a"], r["b"]),
    )
    text = F.array_join(pieces, ", ")
    out = runs.agg(F.when(text == "", "none").otherwise(text).alias("ranges"))
    return out if extra is None else out.withColumn("extra", extra)


def high_hour_ranges(df: DataFrame, quantile: float = 0.75, *, distributed=True) -> DataFrame:
    """The consistently high hours as range text."""
    periods = high_traffic_periods(df, quantile, distributed=distributed)
    return hour_ranges(periods.where("consistently_high"))
