"""Distribution of the target: facts, histogram, peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions.attach import with_row
from tidewatch.functions.quantiles import grouped_summary
from tidewatch.functions.statistics import adjusted_skewness


def distribution_facts(df: DataFrame, target: str = S.TARGET, *, distributed=True) -> DataFrame:
    """Mean, exact median and first quartile, sample deviation, adjusted skewness, and the
    share of values strictly below the first quartile."""
    found = grouped_summary(
        df, [], target, {"median": 0.5, "q1": 0.25},
        [F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"),
         adjusted_skewness(target).alias("skewness")],
        distributed=distributed,
    )
    below = F.avg((F.col(target) < F.col("q1")).cast("double"))
    facts = ["mean", "median", "std", "skewness", "q1"]
    return with_row(df.select(target), found).agg(
        *[F.max(c).alias(c) for c in facts], (F.lit(100.0) * below).alias("below_q1_pct")
    )


def histogram(df: DataFrame, bins: int = 20, target: str = S.TARGET) -> DataFrame:
    """Equal-width histogram on every bin; the last bin is closed on the right.

    A constant input is widened by half a unit on both sides.
    """
    value = F.col(target).cast("double")
    lo, hi = F.min(value), F.max(value)
    low = F.when(lo == hi, lo - 0.5).otherwise(lo)
    high = F.when(lo == hi, hi + 0.5).otherwise(hi)
    ends = df.agg(low.alias("low"), ((high - low) / F.lit(float(bins))).alias("width"))
    index = F.least(F.floor((value - F.col("low")) / F.col("width")), F.lit(bins - 1)).cast("int")
    counts = (
        with_row(df.select(target).where(F.col(target).isNotNull()), ends)
        .groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    )
    frame = df.sparkSession.range(0, bins, numPartitions=1).select(F.col("id").cast("int").alias("bin"))
    joined = with_row(frame.join(F.broadcast(counts), "bin", "left"), ends)  # <= bins rows
    return joined.select(
        "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("lower_edge"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("upper_edge"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def smoothed_histogram(df: DataFrame, bins: int = 20, target: str = S.TARGET) -> DataFrame:
    """Three-point moving average of the histogram (zero beyond its ends), peaks marked.

    A peak is an inner bin strictly above both neighbours and above 0.3 of the maximum. The
    windows run over ``bins`` rows.
    """
    order = Window.orderBy("bin")
    whole = Window.partitionBy()

    def shifted(name: str, by: int):
        return F.lag(name, by).over(order)

    third = F.lit(1.0) / F.lit(3.0)
    smooth = (
        F.coalesce(shifted("count", 1), F.lit(0)) * third
        + F.col("count") * third
        + F.coalesce(shifted("count", -1), F.lit(0)) * third
    )
    out = histogram(df, bins, target).select("bin", "count", smooth.alias("smooth"))
    inner = (F.col("bin") > 0) & (F.col("bin") < bins - 1)
    above = (F.col("smooth") > shifted("smooth", 1)) & (F.col("smooth") > shifted("smooth", -1))
    tall = F.col("smooth") > F.lit(0.3) * F.max("smooth").over(whole)
    return out.withColumn("is_peak", F.coalesce(inner & above & tall, F.lit(False)))


def peak_count(df: DataFrame, bins: int = 20, target: str = S.TARGET) -> DataFrame:
    """Number of peaks of the smoothed histogram."""
    return smoothed_histogram(df, bins, target).agg(F.count_if("is_peak").alias("peaks"))
