"""The whole cleaning pipeline, its report and the explained steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.operators import cleaning as C
from tidewatch.operators import quality as Q


def parse(raw: DataFrame) -> DataFrame:
    """Typed rows, nothing removed yet."""
    S.require_columns(raw, [*S.REQUIRED_COLUMNS, S.ROW_ORD], "raw table")
    return raw.transform(C.parse_dates).transform(C.coerce_numbers)


def clean(raw: DataFrame) -> DataFrame:
    """Raw records to the clean table: one row per timestamp with calendar features."""
    valid = parse(raw).transform(C.valid_rows)
    return (
        valid.transform(C.first_per_time)
        .transform(C.spread_labels, C.holiday_labels(valid))
        .transform(C.apply_bounds)
        .transform(C.calendar_features)
    )


def report(raw: DataFrame) -> DataFrame:
    """Every cleaning counter in one row, from a single read of the raw table.

    The plan is a chain whose intermediate results shrink: distinct rows (rejected rows keep
    only their reason) -> one row per timestamp -> clock hours -> days -> one row. Counters
    travel along as sums.
    """
    parsed = parse(raw).withColumn("reason", C.reject_reason())
    columns = [c for c in parsed.columns if c not in (S.ROW_ORD, "reason")]
    usable = F.col("reason").isNull()
    folded = C.distinct_rows(
        parsed.select(
            "reason", S.ROW_ORD, *[F.when(usable, F.col(c)).alias(c) for c in columns]
        )
    )
    weather = F.struct(*[F.col(c) for c in [*S.LIMITS, S.TARGET]])
    per_time = folded.groupBy("reason", S.TIME).agg(
        F.sum("copies").alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.max(C.has_label()).alias("labelled"),
        F.min_by(weather, S.ROW_ORD).alias("first"),
    )

    kept = F.col("reason").isNull()
    invalid = {}
    for name, (low, high) in S.LIMITS.items():
        value = F.col(f"first.{name}")
        invalid[f"invalid_{name}"] = F.count_if(kept & ((value < low) | (value > high)))
    counters = {
        "rows_raw": F.sum("rows"),
        "invalid_dates_removed": F.sum(F.when(F.col("reason") == "invalid_date", F.col("rows"))),
        "missing_or_negative_target_removed": F.sum(
            F.when(F.col("reason").isin("missing_target", "negative_target"), F.col("rows"))
        ),
        "exact_duplicates_removed": F.sum(F.when(kept, F.col("rows") - F.col("distinct_rows"))),
        "duplicate_timestamps_removed": F.sum(F.when(kept, F.col("distinct_rows") - 1)),
        **invalid,
        "zero_traffic_rows_kept": F.count_if(kept & (F.col(f"first.{S.TARGET}") == 0)),
        "rows_clean": F.count_if(kept),
    }
    names = list(counters)
    again = [F.sum(c).alias(c) for c in names]

    hours = Q.hour_edges(
        per_time,
        *[expr.alias(name) for name, expr in counters.items()],
        F.max(F.when(kept, F.col("labelled"))).alias("labelled"),
    )
    days = Q.day_gaps(hours, *again, F.max("labelled").alias("labelled"))
    total = Q.gap_totals(days, *again, F.count_if("labelled").alias("holiday_days"))
    filled = total.select(
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names],
        F.col("holiday_days").cast("long").alias("holiday_days"),
        F.col("time_gaps").cast("long").alias("time_gaps"),
        "longest_gap_days",
    )
    return filled.withColumn("rows_removed", F.col("rows_raw") - F.col("rows_clean"))


def steps(raw: DataFrame) -> DataFrame:
    """The report as ordered sentences (``ord``, ``step``, ``text``)."""
    r = report(raw)
    texts = [
        ("parse_dates", "%d record(s) dropped because their date and time could not be read.",
         ["invalid_dates_removed"]),
        ("valid_target", "%d record(s) dropped because the measured volume is missing or below zero.",
         ["missing_or_negative_target_removed"]),
        ("holiday_labels", "%d day(s) carry a holiday label; it was copied to every record of the day "
         "before any duplicate was removed.", ["holiday_days"]),
        ("exact_duplicates", "%d exact copies of other records dropped.", ["exact_duplicates_removed"]),
        ("one_per_time", "%d further record(s) shared their timestamp with an earlier one; the first "
         "in input order was kept.", ["duplicate_timestamps_removed"]),
        ("text_fill", "Days without a holiday read 'None' and missing weather text reads 'Unknown'.", []),
        ("bounds", "Implausible readings set to missing, rows kept: temp %d, rain_1h %d, snow_1h %d, "
         "clouds_all %d.", [f"invalid_{c}" for c in S.LIMITS]),
        ("zero_volume", "%d record(s) with volume 0 kept.", ["zero_traffic_rows_kept"]),
        ("calendar", "Calendar columns, weekend and holiday flags and Celsius were added.", []),
        ("continuity", "%d gap(s) of more than an hour between consecutive records, the longest "
         "about %.1f day(s); none was filled.", ["time_gaps", "longest_gap_days"]),
    ]
    entries = F.array(*[
        F.struct(
            F.lit(i).alias("ord"), F.lit(name).alias("step"),
            F.format_string(text, *[F.col(c) for c in args]).alias("text"),
        )
        for i, (name, text, args) in enumerate(texts, 1)
    ])
    return r.select(F.inline(entries))
