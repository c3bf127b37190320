"""Rows that several test modules share, and how results are compared."""

from __future__ import annotations

from datetime import datetime, timedelta
from random import Random

from pyspark.sql import DataFrame

RAW_DDL = (
    "holiday string, temp double, rain_1h double, snow_1h double, clouds_all int, weather_main string, "
    "weather_description string, date_time string, traffic_volume double, row_ord long"
)

# Nine records of four days: one good hour that occurs three times over and once more with other
# weather; a temperature, a snowfall, a rainfall and a cloud cover that cannot be; a day with a
# label; an hour without volume. Not in order of time.
DEFECT_ROWS = [
    ("None", 281.4, 0.0, 0.0, 62, "Rain", "steady rain", "2021-11-11 18:00:00", 3100.0),
    ("None", 279.0, 0.0, 250.0, 20, "Snow", "much snow", "2021-11-13 09:00:00", 700.0),
    ("None", 281.4, 0.0, 0.0, 62, "Rain", "steady rain", "2021-11-11 18:00:00", 3100.0),
    ("None", 150.0, 0.0, 0.0, 15, "Clear", "clear", "2021-11-11 03:00:00", 120.0),
    ("Harvest Home", 279.9, 0.0, 0.0, 20, "Clear", "clear", "2021-11-13 00:00:00", 900.0),
    ("None", 282.0, 0.4, 0.0, 80, "Fog", "low fog", "2021-11-11 18:00:00", 3050.0),
    ("None", 281.4, 0.0, 0.0, 62, "Rain", "steady rain", "2021-11-11 18:00:00", 3100.0),
    ("None", 280.0, -3.0, 0.0, 40, "Mist", "mist", "2021-11-14 21:00:00", 0.0),
    ("None", 283.2, 0.0, 0.0, 130, "Clouds", "overcast", "2021-11-15 06:00:00", 2000.0),
]


def raw_frame(spark, rows) -> DataFrame:
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], RAW_DDL)


SPIKE_ROW, SPIKE = 777, 12_500.0


def hourly_rows(days: int, seed: int = 23):
    """From a Monday in September: a tent around 13 h, a short rise at 20 h, calm Sundays and
    Saturdays, a slow growth over the weeks, and one spike. Cloud cover lowers the volume a little."""
    rng = Random(seed)
    rows = []
    for n in range(24 * days):
        when = datetime(2022, 9, 5) + timedelta(hours=n)
        tent = max(0, 6 - abs(when.hour - 13)) * 450
        late = 700 if when.hour == 20 else 0
        share = 0.5 if when.weekday() > 4 else 1.0
        clouds = rng.choice((0, 20, 75, 90))
        volume = 300 + share * (tent + late) + n * 0.05 - clouds * 0.4 + rng.uniform(-60, 60)
        rows.append((
            "None", 288.0 + rng.uniform(-6, 6), 0.0, 0.0, clouds, rng.choice(("Clear", "Clouds")), "sky",
            when.strftime("%Y-%m-%d %H:%M:%S"), SPIKE if n == SPIKE_ROW else float(round(volume)),
        ))
    return rows


def rows_of(df: DataFrame, *columns) -> list[tuple]:
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: [(v is not None, str(v)) for v in r])
