"""Generated findings: structured facts first, sentences second."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions.scalars import date_label, day_name, hour_label, round_to
from tidewatch.operators.peaks import hour_ranges, top_observations
from tidewatch.operators.profiles import first_max, first_min, high_traffic_periods

FACTS = [
    "no_data", "busiest_hour", "quietest_hour", "busiest_day", "quietest_day", "weekday_mean",
    "weekend_mean", "weekday_vs_weekend_pct", "weekday_peak", "weekend_peak", "high_hours",
    "highest_record",
]


def facts(df: DataFrame, target: str = S.TARGET, *, distributed=True) -> DataFrame:
    """Ordered facts (``ord``, ``fact``, ``label``, ``value``).

    All means come from one pass: sums and counts per weekday and hour (168 rows) that are
    added up per hour, per weekday and per day type. An empty input gives the single fact
    ``no_data``.
    """
    cells = df.groupBy("day_of_week", "hour").agg(
        F.sum(target).alias("total"), F.count(target).alias("n")
    )
    weekend = (F.col("day_of_week") >= 5).cast("int").alias("is_weekend")
    mean = F.sum("total") / F.sum("n")

    def fact(order: int, name: str, label=None, value=None):
        return F.struct(
            F.lit(order).alias("ord"), F.lit(name).alias("fact"),
            F.lit(label).cast("string").alias("label"), F.lit(value).cast("double").alias("value"),
        )

    def rows(table: DataFrame, *entries) -> DataFrame:
        return table.select(F.inline(F.array(*entries)))

    def extremes(key: str) -> DataFrame:
        shown = cells.groupBy(key).agg(round_to(mean, 1).alias("mean"))
        return shown.agg(
            first_max("mean", key).alias("best"), F.max("mean").alias("high"),
            first_min("mean", key).alias("worst"), F.min("mean").alias("low"),
        )

    hours, days = extremes("hour"), extremes("day_of_week").where("best IS NOT NULL")
    by_type = cells.groupBy(weekend, "hour").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), round_to(mean, 1).alias("mean")
    ).groupBy("is_weekend").agg(
        mean.alias("mean"), first_max("mean", "hour").alias("peak"), F.max("mean").alias("peak_mean"),
    )

    def side(flag: int, name: str):
        return F.max(F.when(F.col("is_weekend") == flag, F.col(name)))

    types = by_type.agg(*[
        side(flag, name).alias(f"{prefix}_{name}")
        for flag, prefix in ((0, "wk"), (1, "we")) for name in ("mean", "peak", "peak_mean")
    ]).where("wk_mean IS NOT NULL AND we_mean IS NOT NULL")
    wk, we = F.col("wk_mean"), F.col("we_mean")
    diff = F.lit(100.0) * (wk - we) / F.nullif(we, F.lit(0.0))

    periods = high_traffic_periods(df, distributed=distributed)
    high = hour_ranges(periods.where("consistently_high"), periods.agg(
        F.max("threshold").alias("threshold")
    ).scalar()).where("extra IS NOT NULL")
    top = top_observations(df, 1)
    record = F.concat_ws(" ", date_label(S.TIME), hour_label("hour"), F.col("day_name"))

    parts = [
        rows(hours.where("best IS NULL"), fact(0, "no_data")),
        rows(hours.where("best IS NOT NULL"),
             fact(1, "busiest_hour", hour_label("best"), F.col("high")),
             fact(2, "quietest_hour", hour_label("worst"), F.col("low"))),
        rows(days,
             fact(3, "busiest_day", day_name("best"), F.col("high")),
             fact(4, "quietest_day", day_name("worst"), F.col("low"))),
        rows(types,
             fact(5, "weekday_mean", None, wk),
             fact(6, "weekend_mean", None, we),
             fact(7, "weekday_vs_weekend_pct",
                  F.when(diff >= 0, "higher").otherwise("lower"), diff),
             fact(8, "weekday_peak", hour_label("wk_peak"), F.col("wk_peak_mean")),
             fact(9, "weekend_peak", hour_label("we_peak"), F.col("we_peak_mean"))),
        rows(high, fact(10, "high_hours", F.col("ranges"), F.col("extra"))),
        rows(top, fact(11, "highest_record", record, F.col(target))),
    ]
    return reduce(DataFrame.unionByName, parts)


def sentences(found: DataFrame) -> DataFrame:
    """The facts as ordered sentences (``ord``, ``text``)."""
    def of(name: str, column: str):
        return F.max(F.when(F.col("fact") == name, F.col(column)))

    wide = found.agg(*[
        e for name in FACTS for e in (
            of(name, "label").alias(f"{name}_label"), of(name, "value").alias(f"{name}_value"),
            F.max(F.col("fact") == name).alias(name),
        )
    ])

    def label(name: str):
        return F.col(f"{name}_label")

    def value(name: str, digits: int = 0):
        return F.format_number(F.col(f"{name}_value"), digits)

    def line(order: int, needs: str, *parts):
        texts = [F.lit(p) if isinstance(p, str) else p for p in parts]
        return F.when(F.col(needs), F.struct(F.lit(order).alias("ord"), F.concat(*texts).alias("text")))

    diff = F.format_number(F.abs(F.col("weekday_vs_weekend_pct_value")), 1)
    lines = F.array_compact(F.array(
        line(0, "no_data", "The selection holds no records."),
        line(1, "busiest_hour", "On average the busiest hour starts at ", label("busiest_hour"), " (mean ",
             value("busiest_hour"), ") and the quietest at ", label("quietest_hour"), " (mean ",
             value("quietest_hour"), ")."),
        line(2, "busiest_day", label("busiest_day"), " has the highest daily mean (", value("busiest_day"),
             "), ", label("quietest_day"), " the lowest (", value("quietest_day"), ")."),
        line(3, "weekday_mean", "The weekday mean of ", value("weekday_mean"), " is ",
             F.coalesce(diff, F.lit("?")), " % ", label("weekday_vs_weekend_pct"),
             " than the weekend mean of ", value("weekend_mean"), "."),
        line(4, "weekday_peak", "Weekdays peak at ", label("weekday_peak"), " (", value("weekday_peak"),
             "), weekends at ", label("weekend_peak"), " (", value("weekend_peak"), ")."),
        line(5, "high_hours", "At least half of the records exceed ", value("high_hours"),
             " (the upper quartile) during: ", label("high_hours"), "."),
        line(6, "highest_record", "The highest single record is ", value("highest_record"), " on ",
             label("highest_record"), "."),
    ))
    return wide.select(F.inline(lines))
