"""Cleaning steps. Each is DataFrame to DataFrame; their order carries meaning.

parse -> coerce -> valid target -> day labels -> one row per time -> spread labels -> bounds ->
calendar. ``tidewatch.plans.cleaning`` composes them.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions.attach import by_group
from tidewatch.functions.scalars import (
    day_name, month_name, start_of_day, to_number, to_time,
)

TIME_SHAPE = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})?$"


def parse_dates(raw: DataFrame, shape: str = TIME_SHAPE) -> DataFrame:
    """``date_time`` as timestamp_ntz, null where the text is not a full date and time."""
    return raw.withColumn(S.TIME, to_time(raw, S.TIME, shape))


def coerce_numbers(raw: DataFrame, columns=tuple(S.NUMERIC_COLUMNS)) -> DataFrame:
    """Measurement columns as double, null where the text is not a number."""
    return raw.withColumns({c: to_number(raw, c) for c in columns})


def reject_reason() -> Column:
    """Why a parsed row cannot be used; null for a usable row."""
    return (
        F.when(F.col(S.TIME).isNull(), "invalid_date")
        .when(F.col(S.TARGET).isNull(), "missing_target")
        .when(F.col(S.TARGET) < 0, "negative_target")
    )


def valid_rows(parsed: DataFrame) -> DataFrame:
    """Rows with a time and a target of at least zero (a null target fails the comparison)."""
    return parsed.where(F.col(S.TIME).isNotNull() & (F.col(S.TARGET) >= 0))


def has_label() -> Column:
    return F.col("holiday").isNotNull() & (F.col("holiday") != S.NO_HOLIDAY)


def holiday_labels(valid: DataFrame) -> DataFrame:
    """One row per labelled day: the first label of the day in input order.

    Labels are first reduced to (day, label, earliest position), which is a hash aggregate with
    map-side combining, so a day repeated in a third of all rows still ships a few rows a task.
    """
    day = F.col(S.TIME).cast("date")
    candidates = (
        valid.where(has_label())
        .groupBy(day.alias("day"), "holiday")
        .agg(F.min(S.ROW_ORD).alias("first_ord"))
    )
    return candidates.groupBy("day").agg(F.min_by("holiday", "first_ord").alias("holiday"))


def distinct_rows(valid: DataFrame) -> DataFrame:
    """Exact duplicates (every column equal, null equal to null) folded into one row.

    Adds ``copies`` and keeps the earliest ``row_ord``.
    """
    columns = [c for c in valid.columns if c != S.ROW_ORD]
    return valid.groupBy(*columns).agg(
        F.count(F.lit(1)).alias("copies"), F.min(S.ROW_ORD).alias(S.ROW_ORD)
    )


def first_per_time(valid: DataFrame) -> DataFrame:
    """One row per timestamp, the earliest in input order.

    The rank filter is pushed below the exchange as a group limit, so a task ships at most one
    row per timestamp however often the timestamp repeats.
    """
    order = Window.partitionBy(S.TIME).orderBy(S.ROW_ORD)
    return valid.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def spread_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The day's label on every row of the day, else ``None``; missing weather text filled.

    ``labels`` has one row per labelled calendar day, so it is broadcast.
    """
    labelled = by_group(
        rows.drop("holiday").withColumn("__day", F.col(S.TIME).cast("date")),
        labels.select(F.col("day").alias("__day"), "holiday"),
        ["__day"],
        bound=S.MAX_DAYS,
    )
    filled = labelled.withColumns({
        "holiday": F.coalesce("holiday", F.lit(S.NO_HOLIDAY)),
        "weather_main": F.coalesce("weather_main", F.lit(S.UNKNOWN)),
        "weather_description": F.coalesce("weather_description", F.lit(S.UNKNOWN)),
    })
    return filled.select(*rows.columns)


def out_of_bounds(column: str) -> Column:
    low, high = S.LIMITS[column]
    return (F.col(column) < low) | (F.col(column) > high)


def invalid_counts(rows: DataFrame) -> DataFrame:
    """How many values per weather column are implausible; a null is not."""
    return rows.agg(*[F.count_if(out_of_bounds(c)).alias(f"invalid_{c}") for c in S.LIMITS])


def apply_bounds(rows: DataFrame) -> DataFrame:
    """Implausible weather values become null; the row stays."""
    return rows.withColumns(
        {c: F.when(F.col(c).between(*S.LIMITS[c]), F.col(c)) for c in S.LIMITS}
    )


def calendar_features(rows: DataFrame) -> DataFrame:
    """Celsius, calendar parts, names and flags. Weekday 0 is Monday."""
    ts = F.col(S.TIME)
    numbered = rows.withColumns({
        "temp_c": F.col("temp") - F.lit(S.KELVIN_OFFSET),
        "hour": F.hour(ts),
        "day": F.dayofmonth(ts),
        "month": F.month(ts),
        "year": F.year(ts),
        "day_of_week": F.weekday(ts),
    })
    return numbered.withColumns({
        "day_name": day_name("day_of_week"),
        "month_name": month_name("month"),
        "is_weekend": (F.col("day_of_week") >= 5).cast("int"),
        "is_holiday": (F.col("holiday") != S.NO_HOLIDAY).cast("int"),
        "date": start_of_day(ts),
    })


def filter_by_date(clean: DataFrame, start: str, end: str, *, partitioned: bool = False) -> DataFrame:
    """Rows from ``start`` up to and including the whole day ``end``.

    With ``partitioned`` the year and month columns of a stored clean table are restricted as
    well, which prunes its folders; Spark does not derive that from ``date_time``.
    """
    ts = F.col(S.TIME)
    first = F.lit(start).cast("date")
    after = F.date_add(F.lit(end).cast("date"), 1)
    tests = [ts >= first.cast("timestamp_ntz"), ts < after.cast("timestamp_ntz")]
    if partitioned:
        month = F.col("year") * 100 + F.col("month")
        last = F.lit(end).cast("date")
        tests.append(month.between(
            F.year(first) * 100 + F.month(first), F.year(last) * 100 + F.month(last)
        ))
    return clean.where(reduce(and_, tests))


def date_bounds(clean: DataFrame) -> DataFrame:
    """First and last day present: the defaults of the date filter."""
    return clean.agg(
        start_of_day(F.min(S.TIME)).alias("min_date"), start_of_day(F.max(S.TIME)).alias("max_date")
    )

