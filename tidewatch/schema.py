"""Column names, plausibility limits and errors shared by every operator."""

from __future__ import annotations


class SourceNotFoundError(FileNotFoundError):
    """The path given to a reader does not exist."""


class MissingColumnsError(ValueError):
    """A table lacks columns that an operator needs."""


# Names of the raw observation record.
REQUIRED_COLUMNS = [
    "holiday",
    "temp",
    "rain_1h",
    "snow_1h",
    "clouds_all",
    "weather_main",
    "weather_description",
    "date_time",
    "traffic_volume",
]

TIME = "date_time"
TARGET = "traffic_volume"

# Input position of a record. Any orderable type will do (a long, or the struct the
# CSV reader builds); "first record wins" rules order by it.
ROW_ORD = "row_ord"

NUMERIC_COLUMNS = ["temp", "rain_1h", "snow_1h", "clouds_all", "traffic_volume"]

# Inclusive plausibility limits per column.
LIMITS = {
    "temp": (200.0, 330.0),
    "rain_1h": (0.0, 100.0),
    "snow_1h": (0.0, 100.0),
    "clouds_all": (0.0, 100.0),
}
KELVIN_OFFSET = 273.15

NO_HOLIDAY = "None"
UNKNOWN = "Unknown"

# English calendar names, Monday and January first.
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Texts the pandas CSV reader takes as missing by default.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

OUTLIER_COLUMNS = ["traffic_volume", "temp_c", "rain_1h", "snow_1h", "clouds_all"]
WEATHER_NUMERIC = ["temp_c", "rain_1h", "snow_1h", "clouds_all"]
CORRELATION_COLUMNS = [
    "traffic_volume", "hour", "day_of_week", "month", "is_weekend", "is_holiday",
    "temp_c", "rain_1h", "snow_1h", "clouds_all",
]

IQR_MULTIPLIER = 1.5
ANOMALY_GROUP = ["hour", "is_weekend"]

# How many values a calendar column can take. Group tables keyed only by these have a
# size that is known before any data is read, so they may be broadcast.
CALENDAR_DOMAIN = {
    "hour": 24, "day": 31, "month": 12, "month_name": 12, "day_of_week": 7, "day_name": 7,
    "is_weekend": 2, "is_holiday": 2, "day_type": 2,
}
MAX_BROADCAST_BYTES = 64 << 20

# Calendar days from year 1 to year 9999: the ceiling of any per-day table. Real tables hold
# 36,525 a century.
MAX_DAYS = 3_652_059


def group_bound(keys) -> int | None:
    """Largest number of groups ``keys`` can form, or None when it depends on the data."""
    bound = 1
    for key in keys:
        if key not in CALENDAR_DOMAIN:
            return None
        bound *= CALENDAR_DOMAIN[key] + 1  # one more for null
    return bound


def require_columns(df, names, what: str = "table") -> None:
    """Check column names only: reads the plan's schema, starts no job."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"The {what} lacks column(s) {missing}; it has {df.columns}.")
