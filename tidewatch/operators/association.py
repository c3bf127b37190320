"""Relations between measurements and the target."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions.attach import with_row
from tidewatch.functions.quantiles import exact_quantiles
from tidewatch.functions.sampling import bounded_sample
from tidewatch.functions.scalars import pick, round_to
from tidewatch.functions.statistics import pearson, strength


def correlations_with(
    df: DataFrame, columns=tuple(S.WEATHER_NUMERIC), target: str = S.TARGET
) -> DataFrame:
    """Pearson r of each column with the target, rows where both are present, and its band."""
    columns = list(columns)
    wide = df.agg(
        *[pearson(c, target).alias(c) for c in columns],
        *[F.count_if(F.col(c).isNotNull() & F.col(target).isNotNull()).alias(f"n_{c}") for c in columns],
    )
    rows = wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n"), F.col(c).alias("r"))
        for c in columns
    ])))
    return rows.withColumn("strength", strength("r"))


def scatter_sample(
    df: DataFrame, x: str, target: str = S.TARGET, n: int = 4_000, seed: int = 0,
    key: str = S.ROW_ORD,
) -> DataFrame:
    """A bounded sample of rows that have both values, for a scatter plot."""
    present = df.where(F.col(x).isNotNull() & F.col(target).isNotNull())
    return bounded_sample(present.select(key, x, target), n, key, seed)


def bin_probabilities(bins: int) -> list[float]:
    """Edges of ``bins`` equal shares. Written as a step times a count and through percent, like
    the usual DataFrame libraries do, so that a rank that should be whole carries the same
    last-bit error and the value on the edge lands in the same bin."""
    step = 1.0 / bins
    return [i * step * 100 / 100 for i in range(bins)] + [1.0]


def quantile_trend(
    df: DataFrame, x: str, target: str = S.TARGET, max_bins: int = 12, min_distinct: int = 10,
    *, distributed=True,
) -> DataFrame:
    """Mean x and mean target in up to ``max_bins`` equal-frequency bins of x.

    Bins are closed on the right, the first on both sides; equal edges collapse and empty bins
    do not appear. No rows when x has ``min_distinct`` distinct values or fewer.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(target).isNotNull()).select(
        F.col(x).cast("double").alias("x"), F.col(target).cast("double").alias("y")
    )
    # Only "how many, up to max_bins" matters. The distinct sketch reads few values as few, so an
    # estimate of twice max_bins proves there are more; only below it are values counted exactly,
    # and then they are few.
    distinct = rows.agg(F.approx_count_distinct("x").alias("n")).first()["n"]
    if distinct <= 2 * max_bins:
        distinct = rows.select("x").distinct().count()
    bins = min(distinct, max_bins)
    if bins <= min_distinct:
        return rows.limit(0).select(F.lit(1).alias("bin"), F.col("x").alias("mean_x"), F.col("y").alias("mean_y"), F.lit(0).cast("long").alias("n"))
    found = exact_quantiles(rows, "x", bin_probabilities(bins), distributed=distributed)
    edge_row = found.select(F.array_distinct("q").alias("edges"))
    below = [
        F.coalesce((F.get("edges", F.lit(i)) < F.col("x")).cast("int"), F.lit(0))
        for i in range(bins + 1)
    ]
    bin_id = F.greatest(sum(below[1:], below[0]), F.lit(1))
    return (
        with_row(rows, edge_row)
        .groupBy(bin_id.alias("bin"))
        .agg(
            F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.count(F.lit(1)).alias("n")
        )
    )


_STATE = ["n", "mx", "my", "xx", "yy", "xy", "lox", "hix", "loy", "hiy"]


def _block_state(x: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Central moments and ranges of the column pairs (left, right) of a block, NaN for absent values.

    Sums of all pairs come from a few matrix products of values, squares and presence. Values are
    shifted by their column's mean in the block first, so that nothing large cancels.
    """
    present = ~np.isnan(x)
    there = present.astype(float)
    shift = np.where(present, x, 0.0).sum(axis=0) / np.maximum(there.sum(axis=0), 1)
    v = np.where(present, x - shift, 0.0)
    n = (there.T @ there)[left, right]
    whole = np.maximum(n, 1)
    sums, squares = v.T @ there, (v * v).T @ there
    mx, my = sums[left, right] / whole, sums[right, left] / whole
    xx = squares[left, right] - whole * mx * mx
    yy = squares[right, left] - whole * my * my
    xy = (v.T @ v)[left, right] - whole * mx * my
    low, high = (np.full((x.shape[1], x.shape[1]), fill) for fill in (np.inf, -np.inf))
    for j in range(x.shape[1]):  # the range of every column where column j is present
        rows = x[present[:, j]]
        if len(rows):
            low[:, j] = np.fmin.reduce(rows, axis=0, initial=np.inf)
            high[:, j] = np.fmax.reduce(rows, axis=0, initial=-np.inf)
    return np.array([
        n, mx + shift[left], my + shift[right], xx, yy, xy,
        low[left, right], high[left, right], low[right, left], high[right, left]])


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The state of two blocks together."""
    n = a[0] + b[0]
    whole = np.maximum(n, 1)
    dx, dy, weight = b[1] - a[1], b[2] - a[2], a[0] * b[0] / whole
    out = np.array([
        n, a[1] + dx * b[0] / whole, a[2] + dy * b[0] / whole,
        a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight, a[5] + b[5] + dx * dy * weight,
        np.minimum(a[6], b[6]), np.maximum(a[7], b[7]), np.minimum(a[8], b[8]), np.maximum(a[9], b[9])])
    return np.where(b[0] == 0, a, np.where(a[0] == 0, b, out))


def correlation_matrix(df: DataFrame, columns=tuple(S.CORRELATION_COLUMNS)) -> DataFrame:
    """Pearson r of every pair of columns, each over rows where both are present.

    Rows (a, b, r) for the full square; null where r is undefined. The input is read once and no
    row is multiplied: a task reduces its Arrow batches to one state per pair by matrix products,
    and only these states are shuffled. NaN counts as absent.
    """
    columns = list(columns)
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    left, right = (np.array(side) for side in zip(*pairs))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = np.zeros((len(_STATE), len(pairs)))
        for batch in batches:
            for at in range(0, batch.num_rows, 16_384):
                part = batch.slice(at, 16_384)
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns])
                state = _merged(state, _block_state(x, left, right))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(pairs), dtype=np.int32)), *(pa.array(s) for s in state)], ["pair", *_STATE])

    plain = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    states = plain.mapInArrow(work, ", ".join(["pair int", *(f"{s} double" for s in _STATE)])).where("n > 0")
    # States of all tasks, merged around the mean of all of them.
    everyone = Window.partitionBy("pair")
    total = F.sum("n").over(everyone)
    centred = states.withColumns({
        "dx": F.col("mx") - F.sum(F.col("n") * F.col("mx")).over(everyone) / total,
        "dy": F.col("my") - F.sum(F.col("n") * F.col("my")).over(everyone) / total,
    })

    def moment(name: str, a: str, b: str):
        return F.sum(F.col(name) + F.col("n") * F.col(a) * F.col(b))

    constant = (F.min("lox") == F.max("hix")) | (F.min("loy") == F.max("hiy"))
    size = F.sqrt(moment("xx", "dx", "dx")) * F.sqrt(moment("yy", "dy", "dy"))
    found = centred.groupBy("pair").agg(F.when(~constant, moment("xy", "dx", "dy") / F.nullif(size, F.lit(0.0))).alias("r"))
    names = df.sparkSession.range(0, len(pairs), numPartitions=1).select(
        F.col("id").cast("int").alias("pair"),
        pick([columns[i] for i, _ in pairs], F.col("id").cast("int")).alias("a"),
        pick([columns[j] for _, j in pairs], F.col("id").cast("int")).alias("b"),
    )
    upper = names.join(F.broadcast(found), "pair", "left").select(  # one row per pair
        "a", "b", F.when((F.col("a") == F.col("b")) & F.col("r").isNotNull(), F.lit(1.0))
        .otherwise(F.col("r")).alias("r"),
    )
    mirrored = F.array(
        F.struct("a", "b", "r"),
        F.when(F.col("a") != F.col("b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r")),
    )
    return upper.select(F.inline(F.array_compact(mirrored)))


def rounded_matrix(matrix: DataFrame, digits: int = 2) -> DataFrame:
    """The matrix as shown on a heat map."""
    return matrix.select("a", "b", round_to("r", digits).alias("r"))


def top_correlations(matrix: DataFrame, target: str = S.TARGET, n: int = 3) -> DataFrame:
    """The ``n`` columns most strongly related to the target, with the sign of r."""
    return (
        matrix.where((F.col("a") == target) & (F.col("b") != target) & F.col("r").isNotNull())
        .orderBy(F.desc(F.abs("r")), "b").limit(n)
        .select(F.col("b").alias("column"), "r")
    )
