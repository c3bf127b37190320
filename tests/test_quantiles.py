"""The bounded-step quantiles equal NumPy's, whatever the shape of the data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import quantiles as Q

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def frame(spark, values, keys=None):
    keys = [0] * len(values) if keys is None else keys
    return spark.createDataFrame(
        [(int(k), None if v is None else float(v)) for k, v in zip(keys, values)], "g int, v double"
    ).repartition(5)


RNG = np.random.default_rng(11)
SHAPES = {
    "one": [3.0],
    "two": [1.0, 2.0],
    "constant": [4.5] * 1000,
    "few_values": RNG.integers(0, 5, 3000),
    "heavy_tail": np.exp(RNG.normal(size=3000) * 6),
    "signs": RNG.normal(size=3001),
    "hot_value": np.concatenate([np.full(2000, 7.0), RNG.normal(size=1500)]),
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
@pytest.mark.parametrize("distributed", [True, False])
def test_against_numpy(spark, shape, distributed):
    values = SHAPES[shape]
    row = Q.exact_quantiles(frame(spark, values), "v", PROBS, distributed=distributed).first()
    assert row["n"] == len(values)
    assert row["q"] == pytest.approx(list(np.quantile(np.asarray(values, float), PROBS)), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("shape", ["few_values", "heavy_tail", "hot_value"])
def test_narrow_brackets(spark, monkeypatch, shape):
    """With a coarse sketch even small inputs go through real brackets and slices."""
    monkeypatch.setattr(Q, "_SKETCH", 128)
    monkeypatch.setattr(Q, "_MARGIN", 0.15)
    monkeypatch.setattr(Q, "_SMALL_GROUP", 200)
    monkeypatch.setattr(Q, "_SLICES", 8)
    values = SHAPES[shape]
    row = Q.exact_quantiles(frame(spark, values), "v", PROBS, distributed=True).first()
    assert row["q"] == pytest.approx(list(np.quantile(np.asarray(values, float), PROBS)), rel=1e-12)


def test_large_groups_of_unequal_size(spark):
    """A group with most rows, a small one, and a null key."""
    df = spark.range(120_000).select(
        F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 7 == 0, 1).otherwise(0).alias("hour"),
        (F.exp(F.randn(5) * 3)).alias("v"),
    ).persist()
    far = {r["hour"]: (r["n"], r["q"]) for r in Q.exact_quantiles(df, "v", PROBS, ["hour"], distributed=True).collect()}
    near = {r["hour"]: (r["n"], r["q"]) for r in Q.exact_quantiles(df, "v", PROBS, ["hour"], distributed=False).collect()}
    assert far.keys() == near.keys() == {None, 0, 1}
    for key in near:
        assert far[key][0] == near[key][0]
        assert far[key][1] == pytest.approx(near[key][1], rel=1e-12)


def test_keys_without_a_known_bound(spark):
    df = frame(spark, range(400), [i % 3 for i in range(400)])
    plan = Q.exact_quantiles(df, "v", [0.5], ["g"], distributed=True)
    assert {r["g"]: r["q"][0] for r in plan.collect()} == {0: 199.5, 1: 199.0, 2: 200.0}


@pytest.mark.parametrize("distributed", [True, False])
def test_nulls_and_empty(spark, distributed):
    row = Q.exact_quantiles(frame(spark, [None, 1.0, None, 3.0]), "v", [0.5], distributed=distributed).first()
    assert (row["n"], row["q"]) == (2, [2.0])
    empty = Q.exact_quantiles(frame(spark, [1.0]).limit(0), "v", [0.5], distributed=distributed).collect()
    assert len(empty) == 1 and empty[0]["n"] == 0 and empty[0]["q"] is None
    assert Q.exact_quantiles(frame(spark, [1.0]).limit(0), "v", [0.5], ["g"], distributed=distributed).count() == 0


def test_percentile_only_when_asked_for(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")

    def uses_builtin(frame):
        return "percentile(" in frame._jdf.queryExecution().optimizedPlan().toString().replace("percentile_approx(", "")

    assert not uses_builtin(Q.exact_quantiles(df, "l_quantity", [0.5]))
    assert uses_builtin(Q.exact_quantiles(df, "l_quantity", [0.5], distributed=False))


def test_rows_are_not_shuffled_for_few_groups(spark):
    """Keys without a calendar bound: the group table is measured and sent, the rows stay."""
    from tidewatch.operators import anomalies

    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").withColumn("traffic_volume", F.col("l_extendedprice"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        flagged = anomalies.flag_anomalies(df, ["l_returnflag", "l_linestatus"])
        flagged.write.format("noop").mode("overwrite").save()
        plan = flagged._jdf.queryExecution().executedPlan().toString()
        quantiles = Q.exact_quantiles(df, "l_extendedprice", [0.5], ["l_returnflag"])
        quantiles.collect()
        other = quantiles._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for text in (plan, other):
        assert "BroadcastHashJoin" in text
        assert not any(word in text for word in ("SortMergeJoin", "ShuffledHashJoin", "CartesianProduct"))


def test_distributed_plan_reads_twice(spark):
    """One read for the sketch, when the plan is made; one shared by everything after it."""
    df = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select(F.hour("ts").alias("hour"), "value")
    found = Q.exact_quantiles(df, "value", [0.25, 0.75], ["hour"], distributed=True)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")]
    assert final.count("FileScan") == 1
    assert "ReusedExchange" in final
    assert "CartesianProduct" not in final and "NestedLoop" not in final


def reads(found) -> int:
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")]
    return final.count("FileScan")


def test_summaries_and_columns_read_twice(spark):
    from tidewatch.operators import quality

    df = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select(F.hour("ts").alias("hour"), "value")
    assert reads(Q.grouped_summary(df, ["hour"], "value", {"median": 0.5}, [F.avg("value").alias("mean")])) == 1
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    summary = quality.outlier_summary(lines, columns)
    text = summary._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in text
    found = summary.collect()
    assert len(found) == 4


@pytest.mark.parametrize("shape, coarse", [("two", False), ("constant", True), ("heavy_tail", True), ("heavy_tail", False), ("hot_value", True)])
def test_columns_against_numpy(spark, monkeypatch, shape, coarse):
    if coarse:
        monkeypatch.setattr(Q, "_SKETCH", 128)
        monkeypatch.setattr(Q, "_MARGIN", 0.15)
        monkeypatch.setattr(Q, "_SMALL_GROUP", 200)
    values = np.asarray(SHAPES[shape], float)
    df = spark.createDataFrame([(float(v), None if i % 3 else float(v), None) for i, v in enumerate(values)], "a double, b double, c double").repartition(4)
    found = {r["column"]: r for r in Q.column_quantiles(df, ["a", "b", "c"], [0.25, 0.75], 1.5).collect()}
    assert found.keys() == {"a", "b"}
    for name, x in (("a", values), ("b", values[::3])):
        q1, q3 = np.quantile(x, [0.25, 0.75])
        row, lower, upper = found[name], q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert (row["n"], row["min"], row["max"]) == (len(x), x.min(), x.max())
        assert row["q"] == pytest.approx([q1, q3], rel=1e-12)
        assert row["outside"] == ((x < row["lower"]) | (x > row["upper"])).sum()
        assert (row["lower"], row["upper"]) == pytest.approx((lower, upper), rel=1e-12)


@pytest.mark.parametrize("distributed", [True, False])
def test_grouped_summary(spark, distributed):
    df = frame(spark, range(10), [0] * 4 + [1] * 6)
    found = Q.grouped_summary(
        df, ["g"], "v", {"median": 0.5}, [F.max("v").alias("top")], bound=2, distributed=distributed
    )
    assert {tuple(r) for r in found.collect()} == {(0, 3.0, 1.5), (1, 9.0, 6.5)}
    whole = Q.grouped_summary(df, [], "v", {"median": 0.5}, [F.max("v").alias("top")], distributed=distributed)
    assert tuple(whole.first()) == (9.0, 4.5)
