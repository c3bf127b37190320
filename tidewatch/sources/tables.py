"""Adapters: the observation schema filled from generic event, order and line-item tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.operators import cleaning as C


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _weather(k: Column) -> dict[str, Column]:
    """Weather and holiday columns derived from an event and the number in its properties."""
    kind, value = F.col("event_type"), F.col("value")
    zero = F.lit(0.0)
    return {
        "holiday": F.when((kind == "signup") & k.isin(7, 8), F.concat(F.lit("Day "), k.cast("string")))
        .otherwise(S.NO_HOLIDAY),
        "temp": F.when(k == 0, zero).otherwise(F.lit(260.0) + k * F.lit(0.4)),
        "rain_1h": F.when(kind == "error", value).otherwise(zero),
        "snow_1h": F.when((kind == "view") & (k > 90), value).otherwise(zero),
        "clouds_all": F.when(k == 99, 120).otherwise(k),
    }


def _number() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


def raw_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Dirty raw records from ``events``: every defect the cleaning handles, at hourly grain.

    Every event is kept. Those of some days are moved 90 days on, which leaves a gap in time.
    Every fiftieth event appears twice; the copy is made by ``explode``, so the events are
    read once.
    """
    ts, k = F.col("ts"), F.col("k")
    in_gap = (ts >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")) & (
        ts < F.lit("2024-01-12 06:00:00").cast("timestamp_ntz")
    )
    moved = F.when(in_gap, ts + F.expr("INTERVAL 90 DAYS")).otherwise(ts)
    hour_text = F.format_string("%s %02d:00:00", ts.cast("date").cast("string"), F.hour(ts))
    volume = (
        F.when(F.col("user_id") == 0, None).when(F.col("user_id") == 1, -F.col("value"))
        .when(F.col("user_id") == 2, F.lit(0.0)).otherwise(F.col("value") * 10)
    )
    copies = F.when(F.col("event_id") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    events = load(spark, folder, "events").withColumns({"ts": moved, "k": _number()})
    return events.select(
        F.explode(copies).alias("copy"), F.col("event_id"),
        *[c.alias(name) for name, c in _weather(k).items()],
        F.when(k != 50, F.col("event_type")).alias("weather_main"),
        F.when(k != 50, F.concat_ws(" ", "event_type", k.cast("string"))).alias("weather_description"),
        F.when(k == 98, "not a date").otherwise(hour_text).alias(S.TIME),
        volume.alias(S.TARGET),
    ).select((F.col("event_id") * 2 + F.col("copy")).alias(S.ROW_ORD), *S.REQUIRED_COLUMNS)


def event_observations(spark: SparkSession, folder: str, *, log_volume: bool = False) -> DataFrame:
    """Clean observations at event grain from ``events`` (its timestamps are unique)."""
    value = F.when(F.col("value") > 0, F.log("value")) if log_volume else F.col("value") * 10
    k = F.col("k")
    rows = load(spark, folder, "events").withColumn("k", _number()).select(
        F.col("event_id").alias(S.ROW_ORD),
        *[c.alias(name) for name, c in _weather(k).items()],
        F.col("event_type").alias("weather_main"),
        F.concat_ws(" ", "event_type", k.cast("string")).alias("weather_description"),
        F.col("ts").alias(S.TIME),
        value.alias(S.TARGET),
    )
    return (
        rows.transform(C.coerce_numbers)
        .transform(C.spread_labels, C.holiday_labels(rows))
        .transform(C.apply_bounds)
        .transform(C.calendar_features)
    )


def order_observations(spark: SparkSession, folder: str) -> DataFrame:
    """A long daily series from ``orders``."""
    ts = F.col("o_orderdate")
    return load(spark, folder, "orders").select(
        F.col("o_orderkey").alias(S.ROW_ORD), ts.alias(S.TIME), F.col("o_totalprice").alias(S.TARGET),
        F.col("o_orderpriority").alias("weather_main"), F.month(ts).alias("month"),
    )


def line_items(spark: SparkSession, folder: str) -> DataFrame:
    """``lineitem`` with its extended price in the role of the target."""
    return load(spark, folder, "lineitem").withColumn(S.TARGET, F.col("l_extendedprice"))
