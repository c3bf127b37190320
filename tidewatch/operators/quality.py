"""Data-quality tables: column description, outliers, remaining nulls, continuity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions.attach import with_row
from tidewatch.functions.quantiles import column_quantiles
from tidewatch.functions.scalars import days_between, round_to


OUTLIER_SCHEMA = (
    "column string, min double, max double, lower_fence double, upper_fence double, "
    "outliers long, outlier_pct double"
)


def _per_column(df: DataFrame, columns, value: str, fn) -> DataFrame:
    """One aggregate over ``columns`` turned into rows (column, value)."""
    wide = df.agg(*[fn(c).alias(c) for c in columns])
    return wide.unpivot([], columns, "column", value)


def missing_counts(df: DataFrame, columns=None) -> DataFrame:
    columns = list(columns or df.columns)
    return _per_column(df, columns, "missing", lambda c: F.count_if(F.col(c).isNull()))


def describe_columns(df: DataFrame, columns=None) -> DataFrame:
    """One row per column: position, name, type, rows of the table, missing values.

    A text column whose values all are whole numbers, or all numbers, is shown as such: it is
    what a reader that guesses types would make of it.
    """
    columns = list(columns or df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    texts = [c for c in columns if types[c] == "string"]

    def shown_type(c: str):
        if c not in texts:
            return F.lit(types[c])
        values = F.col("__rows") - F.col(c)
        return (
            F.when((values > 0) & (F.col(f"__whole_{c}") == values), "bigint")
            .when((values > 0) & (F.col(f"__number_{c}") == values), "double").otherwise("string")
        )

    entries = [
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"), shown_type(c).alias("data_type"),
            F.col("__rows").alias("rows"), F.col(c).alias("missing"),
        )
        for i, c in enumerate(columns, 1)
    ]
    wide = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns],
        *[F.count_if(F.col(c).rlike("^ *[+-]?[0-9]+ *$")).alias(f"__whole_{c}") for c in texts],
        *[F.count_if(F.col(c).try_cast("double").isNotNull()).alias(f"__number_{c}") for c in texts],
    )
    return wide.select(F.inline(F.array(*entries)))


def remaining_missing(clean: DataFrame, columns=None) -> DataFrame:
    """Columns that still hold nulls, with how many."""
    return missing_counts(clean, columns).where("missing > 0")


def outlier_summary(
    df: DataFrame, columns=tuple(S.OUTLIER_COLUMNS), multiplier: float = S.IQR_MULTIPLIER,
    *, distributed: bool = True,
) -> DataFrame:
    """Per numeric column: range, interquartile fences, values strictly outside and their share.

    Columns that are absent or hold only nulls give no row. All columns are done by the same two
    reads: sketches, then the values around quartiles and fences.
    """
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df.sparkSession.createDataFrame([], OUTLIER_SCHEMA)
    if distributed:
        found = column_quantiles(df, columns, [0.25, 0.75], multiplier)
    else:
        found = _outliers_by_percentile(df, columns, multiplier)
    return found.select(
        "column",
        *[round_to(c, 2).alias(n) for c, n in (("min", "min"), ("max", "max"), ("lower", "lower_fence"), ("upper", "upper_fence"))],
        F.col("outside").alias("outliers"),
        round_to(F.lit(100.0) * F.col("outside") / F.col("n"), 2).alias("outlier_pct"),
    )


def _outliers_by_percentile(df: DataFrame, columns: list[str], multiplier: float) -> DataFrame:
    """The same from ``percentile``, for columns known to hold few values: one aggregate each."""
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    quartiles = F.array(F.lit(0.25), F.lit(0.75))
    facts = with_row(wide, wide.agg(*[F.percentile(c, quartiles).alias(f"__q_{c}") for c in columns]))
    entries = []
    for c in columns:
        q1, q3 = F.col(f"__q_{c}")[0], F.col(f"__q_{c}")[1]
        lower, upper = q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1)
        entries.append(F.struct(
            F.lit(c).alias("column"), F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"),
            F.max(lower).alias("lower"), F.max(upper).alias("upper"), F.count_if((F.col(c) < lower) | (F.col(c) > upper)).alias("outside")))
    return facts.agg(F.array(*entries).alias("entries")).select(F.inline("entries")).where("n > 0")


def hour_edges(df: DataFrame, *extra, time: str = S.TIME) -> DataFrame:
    """First and last record of every clock hour, with optional further aggregates.

    A hash aggregate on (day, hour): the result is bounded by the time span covered, not by
    the number of rows.
    """
    ts = F.col(time)
    return df.groupBy(ts.cast("date").alias("day"), F.hour(ts).alias("hour")).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), *extra
    )


def day_gaps(edges: DataFrame, *extra) -> DataFrame:
    """Per day: first and last record, gaps over an hour inside the day, the longest of them."""
    order = Window.partitionBy("day").orderBy("hour")
    stepped = edges.withColumn("__prev", F.lag("last_ts").over(order))
    gap = days_between(F.col("first_ts"), F.col("__prev"))
    over_an_hour = F.col("first_ts") > F.col("__prev") + F.expr("INTERVAL 1 HOUR")
    return stepped.groupBy("day").agg(
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.count_if(over_an_hour).alias("gaps"),
        F.max(gap).alias("longest"),
        *extra,
    )


def gap_totals(days: DataFrame, *extra) -> DataFrame:
    """Whole-table gap counters from the per-day table (one row per calendar day)."""
    order = Window.orderBy("day")
    stepped = days.withColumn("__prev", F.lag("last_ts").over(order))
    between = days_between(F.col("first_ts"), F.col("__prev"))
    over_an_hour = F.col("first_ts") > F.col("__prev") + F.expr("INTERVAL 1 HOUR")
    longest = F.max(F.greatest(F.col("longest"), between))
    return stepped.agg(
        (F.coalesce(F.sum("gaps"), F.lit(0)) + F.count_if(over_an_hour)).alias("time_gaps"),
        round_to(F.coalesce(longest, F.lit(0.0)), 1).alias("longest_gap_days"),
        *extra,
    )


def time_gaps(clean: DataFrame, time: str = S.TIME) -> DataFrame:
    """Consecutive records more than one hour apart: how many, and the longest in days.

    A gap above an hour always crosses an hour boundary, so the first and last record of each
    clock hour decide it; no window ever runs over the rows themselves. Shorter gaps round to
    0.0 days.
    """
    return gap_totals(day_gaps(hour_edges(clean, time=time)))
