"""K-means segments of hourly observations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions.attach import with_row
from tidewatch.functions.sampling import bounded_sample, sample_key
from tidewatch.functions.scalars import cyclic_hour, day_type, hour_label, round_to
from tidewatch.session import cut_lineage, release

BASE_COLUMNS = [S.TARGET, "hour", "is_weekend", "temp_c", "clouds_all"]
FEATURES = [S.TARGET, "hour_sin", "hour_cos", "is_weekend", "temp_c", "clouds_all"]

SILHOUETTE_SAMPLE = 5_000
MAX_SILHOUETTE_SAMPLE = 20_000
#: Rows from which starting centres are drawn.
SEED_SAMPLE = 10_000


@dataclass
class Segmentation:
    rows: DataFrame  # input rows with their cluster, a stored table
    model: Centres
    cost: float
    seed: int = 42

    @cached_property
    def summary(self) -> DataFrame:
        """One row per cluster."""
        return describe(self.rows)

    @cached_property
    def silhouette(self) -> DataFrame:
        """One row; computed only when asked for."""
        return silhouette(self.rows, seed=self.seed)


def cluster_features(df: DataFrame) -> DataFrame:
    """Rows complete in the base columns, with the hour on the unit circle."""
    sin, cos = cyclic_hour("hour")
    return df.dropna(subset=BASE_COLUMNS).withColumns({"hour_sin": sin, "hour_cos": cos})


def standardise(df: DataFrame, columns=tuple(FEATURES)) -> DataFrame:
    """``z_<column>``: zero mean and unit population deviation; a constant column becomes 0."""
    stats = df.agg(
        *[F.avg(c).alias(f"__mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"__std_{c}") for c in columns],
        *[(F.min(c) == F.max(c)).alias(f"__flat_{c}") for c in columns],
    )
    scaled = [
        F.when(F.col(f"__flat_{c}"), F.lit(0.0))
        .otherwise((F.col(c) - F.col(f"__mean_{c}")) / F.nullif(f"__std_{c}", F.lit(0.0)))
        .alias(f"z_{c}")
        for c in columns
    ]
    return with_row(df, stats).select(*df.columns, *scaled)


@dataclass
class Centres:
    """Fitted cluster centres in standardised features, numbered by mean volume."""

    points: np.ndarray

    def nearest(self) -> Column:
        """The number of the nearest centre, from the columns ``z_<feature>``; the lowest wins ties."""
        distances = F.array(*[
            sum(((F.col(f"z_{c}") - F.lit(float(v))) ** 2 for c, v in zip(FEATURES[1:], point[1:])),
                (F.col(f"z_{FEATURES[0]}") - F.lit(float(point[0]))) ** 2)
            for point in self.points
        ])
        return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")

    def transform(self, standardised: DataFrame, prediction: str = "prediction") -> DataFrame:
        return standardised.withColumn(prediction, self.nearest())


def _seeds(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ starting centres: each next one by squared distance, the best of a few draws."""
    chosen = [points[rng.integers(len(points))]]
    square = ((points - chosen[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        if not square.sum():  # fewer distinct points than centres
            chosen.append(chosen[0])
            continue
        draws = rng.choice(len(points), 2 + int(np.log(k)), p=square / square.sum())
        tried = [np.minimum(square, ((points - points[d]) ** 2).sum(axis=1)) for d in draws]
        best = int(np.argmin([t.sum() for t in tried]))
        chosen.append(points[draws[best]])
        square = tried[best]
    return np.array(chosen)


def _lloyd_step(features: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, sums and cost per (restart, cluster), all restarts of ``centres`` in one pass."""
    restarts, k, width = centres.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = centres.reshape(-1, width)
        state = np.zeros((restarts * k, 2 + width))
        for batch in batches:
            for at in range(0, batch.num_rows, 8_192):
                part = batch.slice(at, 8_192)
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns])
                # Differences, not the expanded square, whose terms cancel.
                square = ((x[:, None, :] - flat[None, :, :]) ** 2).sum(axis=2).reshape(len(x), restarts, k)
                own = square.argmin(axis=2) + k * np.arange(restarts)
                member = np.zeros((len(x), restarts * k))
                np.put_along_axis(member, own, 1.0, axis=1)
                state[:, 0] += member.sum(axis=0)
                state[:, 1] += (member * square.reshape(len(x), -1)).sum(axis=0)
                state[:, 2:] += member.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(restarts * k)), *(pa.array(c) for c in state.T)], ["slot", *(f"s{i}" for i in range(2 + width))])

    names = [f"s{i}" for i in range(2 + width)]
    states = features.mapInArrow(work, ", ".join(["slot long", *(f"{n} double" for n in names)]))
    rows = states.groupBy("slot").agg(*[F.sum(n).alias(n) for n in names]).collect()  # restarts x k
    total = np.zeros((restarts * k, 2 + width))
    for r in rows:
        total[r["slot"]] = tuple(r)[1:]
    total = total.reshape(restarts, k, -1)
    return total[:, :, 0], total[:, :, 2:], total[:, :, 1].sum(axis=1)


def _best_fit(features: DataFrame, starts: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, float, int]:
    """Centres and cost of the cheapest restart, and the passes made.

    A restart whose centres all moved by no more than ``tol`` drops out of the following passes.
    """
    centres, done, passes = starts.copy(), [], 0
    while len(centres) and passes < max_iter:
        rows, sums, cost = _lloyd_step(features, centres)
        passes += 1
        moved = np.where(rows[:, :, None] > 0, sums / np.maximum(rows, 1)[:, :, None], centres)
        still = np.sqrt(((moved - centres) ** 2).sum(axis=2)).max(axis=1) <= tol
        done += [(float(c), m) for c, m, s in zip(cost, moved, still) if s]
        if passes == max_iter:
            done += [(float(c), m) for c, m, s in zip(cost, moved, still) if not s]
        centres = moved[~still]
    best = min(done, key=lambda f: f[0])[1]
    _, _, cost = _lloyd_step(features, best[None])
    return best, float(cost[0]), passes + 1


def run_kmeans(
    df: DataFrame, k: int = 4, seed: int = 42, restarts: int = 10, *, max_iter: int = 300, tol: float = 1e-4,
    stored: bool = False,
) -> Segmentation:
    """Cluster standardised features; the cheapest of ``restarts`` fits is kept.

    All restarts advance together: one pass over the rows per Lloyd step returns the sums of every
    restart's clusters, so the number of passes is that of the slowest restart. Starting centres
    come from a bounded sample of ``SEED_SAMPLE`` rows, the steps run over all rows. Clusters are
    numbered by mean volume, lowest first, so the ids do not depend on which restart won. The rows
    are written to a table first, because every pass reads them; say ``stored`` when ``df`` is
    read straight from a table already. Select the columns worth keeping beforehand. Neither the
    cluster nor the number of partitions takes part in the result.
    """
    rows = df.dropna(subset=BASE_COLUMNS)
    rows = cluster_features(rows if stored else cut_lineage(rows))
    if rows.limit(10 * k).count() < 10 * k:
        raise ValueError("Too few complete rows to cluster; widen the selection or lower k.")
    names = [f"z_{c}" for c in FEATURES]
    scaled = standardise(rows)
    features = cut_lineage(scaled.select(*names))
    place = F.concat_ws(" ", *[F.format_number(n, 12) for n in names])
    sample = features.orderBy(sample_key(place, seed), place).limit(SEED_SAMPLE).toPandas().to_numpy()
    starts = np.array([_seeds(sample, k, np.random.default_rng(seed + r)) for r in range(restarts)])
    best, cost, _ = _best_fit(features, starts, max_iter, tol)
    volume = FEATURES.index(S.TARGET)
    model = Centres(best[np.lexsort((*best.T[::-1], best[:, volume]))])

    clustered = cut_lineage(scaled.withColumn("cluster", model.nearest()).drop(*names))
    release(features)
    if not stored:
        release(rows)
    return Segmentation(rows=clustered, model=model, cost=cost, seed=seed)


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """Size and means per cluster, two decimals; the weekend share in percent is taken from
    the rounded share, so it moves in steps of 1."""
    share = round_to(F.avg("is_weekend"), 2)
    return clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("observations"),
        round_to(F.avg(S.TARGET), 2).alias("avg_traffic"),
        round_to(F.avg("hour"), 2).alias("avg_hour"),
        round_to(F.lit(100.0) * share, 1).alias("weekend_pct"),
        round_to(F.avg("temp_c"), 2).alias("avg_temp_c"),
        round_to(F.avg("clouds_all"), 2).alias("avg_clouds"),
    )


def common_hours(clustered: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` most frequent hours of each cluster in clock order, as text."""
    order = Window.partitionBy("cluster").orderBy(F.desc("count"), "hour")
    counts = clustered.groupBy("cluster", "hour").agg(F.count(F.lit(1)).alias("count"))
    return (
        counts.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)
        .groupBy("cluster")
        .agg(F.array_join(
            F.transform(F.array_sort(F.collect_list("hour")), hour_label), ", "
        ).alias("common_hours"))
    )


def describe(clustered: DataFrame) -> DataFrame:
    """The cluster summary with a generated description."""
    overall = clustered.agg(F.avg(S.TARGET).alias("m")).scalar()
    ratio = F.coalesce(F.col("avg_traffic") / F.nullif(overall, F.lit(0.0)), F.lit(1.0))
    level = (
        F.when(ratio >= 1.15, "High traffic")
        .when(ratio <= 0.6, "Very low traffic")
        .when(ratio <= 0.9, "Low traffic")
        .otherwise("Average traffic")
    )
    days = (
        F.when(F.col("weekend_pct") >= 60, "mainly weekends")
        .when(F.col("weekend_pct") <= 15, "mainly weekdays")
        .otherwise("weekdays and weekends")
    )
    return (
        cluster_summary(clustered)
        .join(F.broadcast(common_hours(clustered)), "cluster")  # one row per cluster
        .withColumn("description", F.concat(
            level, F.lit(", "), days, F.lit("; most often at "), F.col("common_hours")
        ))
    )


def silhouette(
    clustered: DataFrame, n: int = SILHOUETTE_SAMPLE, seed: int = 42, *,
    label: str = "cluster", key: str = S.ROW_ORD,
) -> DataFrame:
    """Mean Euclidean silhouette of a bounded random sample, as a one-row table.

    Features are standardised over all rows before sampling. The sample has at most ``n``
    points (``n`` itself is limited), so one task holds it and compares it with itself in NumPy
    blocks. Null, of 0 points, where fewer than two clusters are in it. Nothing runs before the
    result is asked for.
    """
    if n > MAX_SILHOUETTE_SAMPLE:
        raise ValueError(f"the silhouette sample is limited to {MAX_SILHOUETTE_SAMPLE} points")
    names = [f"z_{c}" for c in FEATURES]
    points = bounded_sample(
        standardise(clustered).select(key, F.col(label).cast("int").alias("label"), *names),
        n, key, seed,
    ).drop(key)

    def widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        points = pa.Table.from_batches(parts)
        matrix = np.column_stack([points.column(c).to_numpy() for c in names])
        of = points.column("label").to_numpy()
        clusters = np.unique(of)
        if len(clusters) < 2:
            return
        member = (of[:, None] == clusters[None, :]).astype("float64")
        sizes = member.sum(axis=0)
        own = np.searchsorted(clusters, of)
        for first in range(0, len(matrix), 512):
            block, mine = matrix[first: first + 512], own[first: first + 512]
            at = np.arange(len(block))
            square = (
                (block**2).sum(axis=1)[:, None] + (matrix**2).sum(axis=1)[None, :]
                - 2.0 * block @ matrix.T
            )
            # The expansion loses the zero between a point and itself; clip and restore it.
            distance = np.sqrt(np.clip(square, 0.0, None))
            distance[at, first + at] = 0.0
            totals = distance @ member
            inner = totals[at, mine] / np.maximum(sizes[mine] - 1, 1)
            others = totals / sizes
            others[at, mine] = np.inf
            outer = others.min(axis=1)
            width = (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(sizes[mine] > 1, width, 0.0))], ["width"])

    scored = points.coalesce(1).mapInArrow(widths, "width double")
    return scored.agg(
        F.avg("width").alias("silhouette"), F.count(F.lit(1)).alias("points")
    )


def squared_silhouette(assembled: DataFrame, label: str = "cluster") -> float:
    """Squared-Euclidean silhouette over all rows: a different number, but one linear pass."""
    return ClusteringEvaluator(
        featuresCol="features", predictionCol=label, metricName="silhouette"
    ).evaluate(assembled)


def cluster_points(clustered: DataFrame, n: int = 6_000, seed: int = 1) -> DataFrame:
    """A bounded sample of labelled rows for a scatter plot."""
    picked = bounded_sample(clustered, n, seed=seed)
    return picked.select(
        S.TIME, "hour", S.TARGET, "temp_c", "clouds_all", "cluster", day_type().alias("day_type")
    )
