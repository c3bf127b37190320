"""Aggregation profiles over calendar columns, categories and time periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions.attach import with_row
from tidewatch.functions.quantiles import exact_quantiles, grouped_summary
from tidewatch.functions.scalars import (
    column, day_name, day_type, month_name, round_to,
)


def first_max(value: str, key: str):
    """Row key of the largest ``value``; the lowest key wins ties."""
    return F.max_by(key, F.struct(value, -F.col(key)))


def first_min(value: str, key: str):
    """Row key of the smallest ``value``; the lowest key wins ties."""
    return F.min_by(key, F.struct(value, key))


def hourly_profile(df: DataFrame, target: str = S.TARGET, *, distributed=True) -> DataFrame:
    """Per hour of day: mean (one decimal), exact median, number of observations."""
    out = grouped_summary(
        df, ["hour"], target, {"median": 0.5},
        [F.avg(target).alias("mean"), F.count(target).alias("observations")],
        distributed=distributed,
    )
    return out.select("hour", round_to("mean", 1).alias("mean"), "median", "observations")


def day_of_week_profile(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """Mean per weekday (one decimal), Monday first, weekdays present in the data only."""
    return (
        df.groupBy("day_of_week")
        .agg(round_to(F.avg(target), 1).alias("mean_traffic"))
        .select("day_of_week", day_name("day_of_week").alias("day_name"), "mean_traffic")
        .orderBy("day_of_week")
    )


def day_type_profile(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """Mean per hour of day, weekdays and weekends apart."""
    return (
        df.groupBy("hour", "is_weekend")
        .agg(round_to(F.avg(target), 1).alias("mean_traffic"))
        .select("hour", day_type().alias("day_type"), "mean_traffic")
    )


def high_traffic_threshold(
    df: DataFrame, quantile: float = 0.75, target: str = S.TARGET, *, distributed=True
) -> DataFrame:
    """The quantile of all volumes that counts as high, as a one-row table."""
    found = exact_quantiles(df, target, [quantile], distributed=distributed)
    return found.select(F.col("q")[0].alias("threshold"))


def high_traffic_periods(
    df: DataFrame, quantile: float = 0.75, target: str = S.TARGET, *, distributed=True
) -> DataFrame:
    """Per hour: mean, share of records strictly above the threshold, and whether the shown
    (rounded) share reaches half. The threshold is carried along as a column."""
    rows = with_row(
        df.select("hour", target),
        high_traffic_threshold(df, quantile, target, distributed=distributed),
    )
    above = F.avg((F.col(target) > F.col("threshold")).cast("double"))
    share = rows.groupBy("hour").agg(
        round_to(F.avg(target), 1).alias("mean_traffic"),
        round_to(F.lit(100.0) * above, 1).alias("share_above_threshold"),
        F.max("threshold").alias("threshold"),
    )
    return share.select(
        "hour", "mean_traffic", "share_above_threshold",
        (F.col("share_above_threshold") >= 50).alias("consistently_high"), "threshold",
    )


def hour_spread(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """Per hour: mean and sample standard deviation (0 where one record gives none)."""
    return df.groupBy("hour").agg(
        F.avg(target).alias("mean"),
        F.coalesce(F.stddev_samp(target), F.lit(0.0)).alias("std"),
    )


def _dense(df: DataFrame, profile: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """``profile`` (at most one row per key) on every key of ``start .. end - 1``."""
    frame = df.sparkSession.range(start, end, numPartitions=1).select(
        F.col("id").cast("int").alias(key)
    )
    return frame.join(F.broadcast(profile), key, "left")


def day_dense(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """Mean per weekday on all seven days; null where the data has none."""
    means = df.groupBy("day_of_week").agg(F.avg(target).alias("mean"))
    return _dense(df, means, "day_of_week", 0, 7).select(
        "day_of_week", day_name("day_of_week").alias("day_name"), "mean"
    )


def month_dense(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """Mean per calendar month on all twelve months; null where the data has none."""
    means = df.groupBy("month").agg(F.avg(target).alias("mean"))
    return _dense(df, means, "month", 1, 13).select(
        "month", month_name("month").alias("month_name"), "mean"
    )


def _extremes(profile: DataFrame, key: str, value: str = "mean") -> DataFrame:
    present = profile.where(F.col(value).isNotNull())
    return present.agg(
        first_max(value, key).alias(f"highest_{key}"),
        F.max(value).alias("highest_mean"),
        first_min(value, key).alias(f"lowest_{key}"),
        F.min(value).alias("lowest_mean"),
    )


def hour_extremes(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """Hours with the highest and lowest mean."""
    return _extremes(hour_spread(df, target), "hour")


def day_extremes(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """Weekdays with the highest and lowest mean, and their gap in percent of the lowest."""
    found = _extremes(
        df.groupBy("day_of_week").agg(F.avg(target).alias("mean")), "day_of_week"
    )
    gap = F.col("highest_mean") - F.col("lowest_mean")
    return found.select(
        day_name("highest_day_of_week").alias("highest_day"), "highest_mean",
        day_name("lowest_day_of_week").alias("lowest_day"), "lowest_mean",
        (F.lit(100.0) * gap / F.nullif("lowest_mean", F.lit(0.0))).alias("gap_pct"),
    )


def month_extremes(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """Months with the highest and lowest mean."""
    found = _extremes(df.groupBy("month").agg(F.avg(target).alias("mean")), "month")
    return found.select(
        month_name("highest_month").alias("highest_month"), "highest_mean",
        month_name("lowest_month").alias("lowest_month"), "lowest_mean",
    )


def heatmap(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """Mean per weekday (rows) and hour (columns ``h00`` .. ``h23``) on the full 7 x 24 grid."""
    cells = df.groupBy("day_of_week").pivot("hour", list(range(24))).agg(F.avg(target))
    named = cells.select("day_of_week", *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)])
    return _dense(df, named, "day_of_week", 0, 7)


def heatmap_extremes(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """Hottest and coolest weekday-hour cell; the first in weekday, hour order wins ties."""
    cells = df.groupBy("day_of_week", "hour").agg(F.avg(target).alias("mean"))
    place = (F.col("day_of_week") * 24 + F.col("hour")).alias("place")
    found = _extremes(cells.select(place, "mean"), "place")

    def cell(prefix: str):
        at = F.col(f"{prefix}_place")
        return [
            day_name(F.floor(at / 24).cast("int")).alias(f"{prefix}_day"),
            (at % 24).alias(f"{prefix}_hour"),
            F.col(f"{prefix}_mean"),
        ]

    return found.select(*cell("highest"), *cell("lowest"))


def category_profile(df: DataFrame, by: str = "weather_main", target: str = S.TARGET) -> DataFrame:
    """Mean and count per category, highest mean first."""
    return (
        df.groupBy(by)
        .agg(F.avg(target).alias("mean"), F.count(target).alias("count"))
        .orderBy(F.desc("mean"), by)
    )


def category_extremes(df: DataFrame, by: str = "weather_main", target: str = S.TARGET) -> DataFrame:
    """First and last row of the category profile, with their counts."""
    profile = df.groupBy(by).agg(F.avg(target).alias("mean"), F.count(target).alias("count"))
    names = [by, "mean", "count"]

    def first(side: str, *order) -> DataFrame:
        labels = [f"{side}_category", f"{side}_mean", f"{side}_n"]
        return profile.orderBy(*order).limit(1).select(
            *[F.col(n).alias(label) for n, label in zip(names, labels)]
        )

    high = first("highest", F.desc("mean"), F.asc(by))
    return with_row(high, first("lowest", F.asc("mean"), F.desc(by)))


def kpis(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """Rows, mean, maximum, and the hour with the highest (rounded) mean.

    One pass: the per-hour table carries sums, counts and maxima up to the total.
    """
    per_hour = df.groupBy("hour").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(target).alias("total"),
        F.count(target).alias("n"), F.max(target).alias("top"),
        round_to(F.avg(target), 1).alias("mean"),
    )
    return per_hour.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("observations"),
        (F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("mean_traffic"),
        F.max("top").alias("max_traffic"),
        first_max("mean", "hour").alias("busiest_hour"),
        F.max("mean").alias("busiest_hour_mean"),
    )


_PERIODS = {
    "daily": lambda day: day,
    "weekly": lambda day: F.date_add(day, 6 - F.weekday(day)),
    "monthly": lambda day: F.trunc(day, "MM"),
}


def resample(df: DataFrame, period: str = "weekly", target: str = S.TARGET) -> DataFrame:
    """Mean per period; periods without records do not appear.

    A day is labelled by its midnight, a Monday-to-Sunday week by its Sunday, a month by its
    first day. ``hourly`` returns the records as they are.
    """
    if period == "hourly":
        return df.select(S.TIME, target)
    if period not in _PERIODS:
        raise ValueError(f"period must be hourly, {', '.join(_PERIODS)}; not {period!r}")
    label = _PERIODS[period](F.col(S.TIME).cast("date")).cast("timestamp_ntz")
    return (
        df.groupBy(label.alias(S.TIME)).agg(F.avg(target).alias(target))
        .where(F.col(target).isNotNull())
    )


def resample_facts(df: DataFrame, period: str = "weekly", target: str = S.TARGET) -> DataFrame:
    """How many points a resampled series has, and its first and last."""
    return resample(df, period, target).agg(
        F.count(F.lit(1)).alias("points"),
        F.min(S.TIME).alias("first_point"), F.max(S.TIME).alias("last_point"),
    )


def day_type_difference(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    """Weekday and weekend means and their difference in percent of the weekend mean.

    No row when either kind of day is absent; null difference for a weekend mean of zero.
    """
    value = column(target)
    weekday, weekend = F.when(F.col("is_weekend") == 0, value), F.when(F.col("is_weekend") == 1, value)
    means = df.agg(
        F.avg(weekday).alias("weekday_mean"), F.avg(weekend).alias("weekend_mean")
    ).where("weekday_mean IS NOT NULL AND weekend_mean IS NOT NULL")
    gap = F.lit(100.0) * (F.col("weekday_mean") - F.col("weekend_mean"))
    diff = gap / F.nullif("weekend_mean", F.lit(0.0))
    return means.select(
        "weekday_mean", "weekend_mean", diff.alias("diff_pct"),
        F.when(diff >= 0, "higher").otherwise("lower").alias("direction"),
    )


def categories(df: DataFrame, by: str = "weather_main") -> DataFrame:
    """Distinct values, sorted."""
    return df.select(by).distinct().orderBy(by)
