"""Column helpers: coercion, rounding, calendar parts, labels. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import schema as S

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_SPECIAL = ("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")


def column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_number(df: DataFrame, name: str) -> Column:
    """Column ``name`` as double; anything that is not a number becomes null, NaN included.

    Text is checked against a number pattern first, because a Java parse also takes ``1.0d``
    and hexadecimal floats.
    """
    col = F.col(name)
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        looks_numeric = col.rlike(_NUMBER) | F.lower(F.trim(col)).isin(*_SPECIAL)
        col = F.when(looks_numeric, col.try_cast("double"))
        return col
    number = col.cast("double")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(number), number)
    return number


def to_time(df: DataFrame, name: str, shape: str) -> Column:
    """Column ``name`` as a zone-less timestamp; text must match ``shape`` and be a real date."""
    col = F.col(name)
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.when(col.rlike(shape), col.try_cast("timestamp_ntz"))
    return col.cast("timestamp_ntz")


def blank_missing(col: Column) -> Column:
    """Null for every text that stands for a missing value."""
    return F.when(~col.isin(*S.MISSING_TOKENS), col)


def round_to(col: str | Column, digits: int = 0) -> Column:
    """Round half to even on the scaled value, as NumPy does (Spark's round is half-up).

    Further digits (six, or three beyond two decimals) are settled first. A distributed sum
    carries noise in its last bits that depends on the partitioning; without this the noise
    would decide ties such as 232.5.
    """
    scale, noise = F.lit(10.0**digits), F.lit(1e6 if digits <= 2 else 1e3)
    settled = F.rint(column(col) * scale * noise) / noise
    return F.rint(settled) / scale


def ntz(value) -> Column:
    """A zone-less timestamp literal. Written as text: a literal made from a Python datetime
    would carry the session zone."""
    return F.lit(str(value)).cast("timestamp_ntz")


def start_of_day(ts: str | Column) -> Column:
    """Midnight as timestamp_ntz. Goes through DATE, so no session zone is involved."""
    return column(ts).cast("date").cast("timestamp_ntz")


def pick(names: list[str], index: Column) -> Column:
    """``names[index]`` for a zero-based integer column."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def day_name(day_of_week: str | Column) -> Column:
    return pick(S.DAY_NAMES, column(day_of_week))


def month_name(month: str | Column) -> Column:
    return pick(S.MONTH_NAMES, column(month) - 1)


def day_type(is_weekend: str | Column = "is_weekend") -> Column:
    flag = column(is_weekend)
    return F.when(flag == 0, "Weekday").when(flag == 1, "Weekend")


def hour_label(hour: str | Column) -> Column:
    return F.format_string("%02d:00", column(hour))


def date_label(ts: str | Column) -> Column:
    """``03 Jan 2024``."""
    ts = column(ts)
    return F.format_string(
        "%02d %s %04d", F.dayofmonth(ts), month_name(F.month(ts)), F.year(ts)
    )


def days_between(later: Column, earlier: Column) -> Column:
    """Length of an interval in days as a double.

    Taken from the parts of the difference of two zone-less timestamps; timestamp_diff would
    go through the session zone and its clock changes.
    """
    gap = later - earlier

    def part(unit: str) -> Column:
        return F.extract(F.lit(unit), gap).cast("double")

    hours = part("DAY") * 24 + part("HOUR")
    return ((hours * 60 + part("MINUTE")) * 60 + part("SECOND")) / F.lit(86_400.0)


def cyclic_hour(hour: str | Column) -> tuple[Column, Column]:
    """Hour of day on the unit circle, so that 23:00 and 00:00 are neighbours."""
    angle = F.lit(2.0) * F.pi() * column(hour) / F.lit(24.0)
    return F.sin(angle), F.cos(angle)
