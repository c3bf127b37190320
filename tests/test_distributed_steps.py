"""Steps that replace single-task ones: moments by blocks, prefix sums, modes, joint restarts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import association as M
from tidewatch.operators import regression as R
from tidewatch.operators import segmentation as K


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_correlations_do_not_cancel(spark, offset):
    """Pairwise complete, over several tasks, also where values are far from zero."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 3)) @ np.array([[1, 0.4, 0], [0, 1, 0.7], [0, 0, 1]]) + offset
    x[rng.random(x.shape) < 0.1] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) + (5.0, None) for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, flat double, none double").repartition(7)
    found = {(r["a"], r["b"]): r["r"] for r in M.correlation_matrix(df, ["a", "b", "c", "flat", "none"]).collect()}
    assert len(found) == 25
    for i, p in enumerate("abc"):
        for j, q in enumerate("abc"):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert found[p, q] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-6 if offset else 1e-12)
    assert found["a", "flat"] is None and found["flat", "flat"] is None and found["none", "none"] is None


def test_correlation_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert {r["r"] for r in M.correlation_matrix(df, ["a", "b"]).collect()} == {None}


def test_correlation_reads_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    found = M.correlation_matrix(df, ["l_quantity", "l_discount", "l_tax"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Generate inline" not in plan.split("MapInArrow")[1]


@pytest.mark.parametrize("rank", [0, 41_234, 99_999 * 2 + 1])
def test_prefix_sum_over_many_file_names(spark, rank):
    df = spark.range(200_000).select(F.format_string("f%07d", (F.col("id") / 2).cast("long")).alias("file"))
    found = R._far_bucket_at(df, F.col("file"), rank)
    assert (found["bucket"], found["before"], found["n"]) == (f"f{rank // 2:07d}", rank // 2 * 2, 2)


def test_modes(spark):
    df = spark.createDataFrame(
        [(1, "b", None), (2, "b", None), (2, "a", None), (1, "a", None), (3, None, None), (None, "c", None)], "x int, y string, z string")
    assert tuple(R.modes(df, ["x", "y", "z"]).first()) == (1, "a", None)
    many = spark.range(20_000).select(F.col("id").alias("x"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("y"))
    assert tuple(R.modes(many, ["x", "y"]).first()) == (0, "hot")


def test_all_restarts_take_the_passes_of_the_slowest(spark, series):
    scaled = K.standardise(K.cluster_features(series)).select(*[f"z_{c}" for c in K.FEATURES]).persist()
    points = scaled.toPandas().to_numpy()
    starts = np.array([K._seeds(points, 4, np.random.default_rng(i)) for i in range(4)])
    alone = [K._best_fit(scaled, s[None], 300, 1e-4) for s in starts]
    best, cost, passes = K._best_fit(scaled, starts, 300, 1e-4)
    assert passes == max(a[2] for a in alone)
    assert cost == pytest.approx(min(a[1] for a in alone), rel=1e-9)
    distance = ((points[:, None, :] - best[None]) ** 2).sum(-1)
    assert cost == pytest.approx(distance.min(axis=1).sum(), rel=1e-9)
    scaled.unpersist()
