import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from observations import SPIKE, SPIKE_ROW, rows_of
from tidewatch import schema as S
from tidewatch.functions.sampling import bounded_sample
from tidewatch.functions.scalars import date_label, round_to
from tidewatch.functions.statistics import adjusted_skewness, pearson, strength
from tidewatch.operators import anomalies as N
from tidewatch.operators import association as M
from tidewatch.operators import distribution as D
from tidewatch.operators import peaks as P
from tidewatch.operators import profiles as A
from tidewatch.plans import findings


def volumes(spark, values, **extra):
    columns = {S.TARGET: [None if v is None else float(v) for v in values], **extra}
    pdf = pd.DataFrame(columns).astype({S.TARGET: "float64"})
    df = spark.createDataFrame(pdf)
    return df.withColumn(S.TARGET, F.when(~F.isnan(S.TARGET), F.col(S.TARGET)))


# --- peaks and profiles ------------------------------------------------------------------------


def test_busiest_hour_is_at_the_top_of_the_tent(series):
    top = P.top_hours(series).collect()
    assert len(top) == 5 and [r["hour"] for r in top][0] == 13
    assert top[0]["time_window"] == f"{top[0]['hour']:02d}:00 - {top[0]['hour']:02d}:59"
    assert [r["mean"] for r in top] == sorted((r["mean"] for r in top), reverse=True)


@pytest.mark.parametrize("distributed", [True, False])
def test_profile_matches_pandas(series, distributed):
    pdf = series.select("hour", S.TARGET).toPandas()
    want = pdf.groupby("hour")[S.TARGET].agg(["mean", "median", "count"])
    for r in A.hourly_profile(series, distributed=distributed).collect():
        w = want.loc[r["hour"]]
        assert (r["mean"], r["median"], r["observations"]) == (
            pytest.approx(round(w["mean"], 1), abs=0.05), w["median"], w["count"])


@pytest.mark.parametrize("distributed", [True, False])
def test_high_hours_are_found(series, distributed):
    table = {r["hour"]: r for r in A.high_traffic_periods(series, distributed=distributed).collect()}
    assert table[13]["consistently_high"] and not table[3]["consistently_high"]
    threshold = series.select(S.TARGET).toPandas()[S.TARGET].quantile(0.75)
    assert table[13]["threshold"] == pytest.approx(threshold)
    text = P.high_hour_ranges(series, distributed=distributed).first()["ranges"]
    assert text == "10:00-16:59"


@pytest.mark.parametrize("hours, text", [
    ([], "none"), ([5], "05:00-05:59"), ([7, 8, 15, 16, 17], "07:00-08:59, 15:00-17:59"),
    ([23, 0], "00:00-00:59, 23:00-23:59"), ([3, 3, 4, None], "03:00-04:59"),
    (list(range(24)), "00:00-23:59"),
])
def test_hour_ranges(spark, hours, text):
    df = spark.createDataFrame([(h,) for h in hours], "hour int")
    assert P.hour_ranges(df).first()["ranges"] == text


def test_dense_grids_keep_missing_cells(spark):
    df = volumes(spark, [10, 20, 30], day_of_week=[0, 0, 5], hour=[1, 2, 1], month=[3, 3, 12])
    days = A.day_dense(df).orderBy("day_of_week").collect()
    assert [r["mean"] for r in days] == [15.0, None, None, None, None, 30.0, None]
    months = A.month_dense(df).orderBy("month").collect()
    assert len(months) == 12 and months[2]["month_name"] == "Mar" and months[0]["mean"] is None
    grid = A.heatmap(df).orderBy("day_of_week").collect()
    assert len(grid) == 7 and len(grid[0]) == 25
    assert (grid[0]["h01"], grid[0]["h02"], grid[5]["h01"], grid[3]["h05"]) == (10.0, 20.0, 30.0, None)
    hot = A.heatmap_extremes(df).first()
    assert (hot["highest_day"], hot["highest_hour"], hot["lowest_day"], hot["lowest_hour"]) == ("Saturday", 1, "Monday", 1)
    days = A.day_extremes(df).first()
    assert (days["highest_day"], days["lowest_day"], days["gap_pct"]) == ("Saturday", "Monday", 100.0)


def test_ties_go_to_the_lowest_key(spark):
    df = volumes(spark, [5, 5, 5], day_of_week=[2, 4, 1], hour=[9, 3, 6])
    r = A.hour_extremes(df).first()
    assert (r["highest_hour"], r["lowest_hour"]) == (3, 3)
    assert A.kpis(df).first()["busiest_hour"] == 3


def test_day_type_difference(spark):
    df = volumes(spark, [30, 10, 10], is_weekend=[0, 1, 1])
    r = A.day_type_difference(df).first()
    assert (r["diff_pct"], r["direction"]) == (200.0, "higher")
    assert A.day_type_difference(df.where("is_weekend = 1")).count() == 0
    zero = A.day_type_difference(volumes(spark, [30, 0], is_weekend=[0, 1])).first()
    assert zero["diff_pct"] is None


def test_single_observation_has_no_spread(spark):
    r = A.hour_spread(volumes(spark, [7], hour=[4])).first()
    assert (r["mean"], r["std"]) == (7.0, 0.0)


@pytest.mark.parametrize("period, rule", [("daily", "D"), ("weekly", "W"), ("monthly", "MS")])
def test_resample_matches_pandas(series, period, rule):
    pdf = series.select(S.TIME, S.TARGET).toPandas().set_index(S.TIME)[S.TARGET]
    want = pdf.resample(rule).mean().dropna()
    got = A.resample(series, period).orderBy(S.TIME).toPandas()
    assert list(got[S.TIME]) == list(want.index)
    assert np.allclose(got[S.TARGET], want.to_numpy())


def test_resample_hourly_and_bad_period(series):
    assert A.resample(series, "hourly").count() == series.count()
    with pytest.raises(ValueError, match="period"):
        A.resample(series, "yearly")


# --- anomalies ---------------------------------------------------------------------------------


@pytest.mark.parametrize("distributed", [True, False])
def test_injected_spike_is_high(series, distributed):
    flagged = N.flag_anomalies(series, distributed=distributed)
    spike = flagged.where(f"{S.ROW_ORD} = {SPIKE_ROW}").first()
    assert spike["is_anomaly"] and spike["anomaly_type"] == "High"
    c = N.anomaly_counts(flagged).first()
    assert c["flagged"] == c["high"] + c["low"] and c["total"] == series.count()
    assert N.anomaly_table(flagged, 1).first()["traffic_volume"] == SPIKE
    assert N.anomaly_series(flagged, "High").count() == c["high"]


def test_groups_of_any_column_and_null_keys(spark):
    df = volumes(spark, [1, 2, 3, 100, 50], g=["a", "a", "a", "a", None])
    flagged = N.flag_anomalies(df, ["g"])
    assert flagged.columns[:2] == df.columns
    rows = {r[S.TARGET]: r for r in flagged.collect()}
    assert rows[100.0]["anomaly_type"] == "High"
    assert rows[50.0]["lower_limit"] is None and rows[50.0]["anomaly_type"] == "Normal"


def test_hot_keys_of_many_groups_are_split(spark, monkeypatch):
    """A key with most rows, a group table too large to broadcast: the hot partition is split."""
    monkeypatch.setattr(S, "MAX_BROADCAST_BYTES", 0)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = spark.range(0, 60_000, 1, 8).select(
            F.when(F.col("id") % 10 < 6, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 997)).alias("station"),
            F.rand(4).alias(S.TARGET),
        )
        for distributed in (False, True):
            flagged = N.flag_anomalies(df, ["station"], distributed=distributed)
            assert len(flagged.collect()) == 60_000
            assert "skew=true" in flagged._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_global_limits_match_pandas(series):
    values = series.select(S.TARGET).toPandas()[S.TARGET]
    q1, q3 = values.quantile(0.25), values.quantile(0.75)
    r = N.flag_anomalies(series, (), 1.2).first()
    assert r["lower_limit"] == pytest.approx(q1 - 1.2 * (q3 - q1))
    assert r["upper_limit"] == pytest.approx(q3 + 1.2 * (q3 - q1))


def test_nothing_flagged(spark):
    df = volumes(spark, [5, 5, 5], hour=[1, 1, 1], is_weekend=[0, 0, 0])
    counts = N.anomaly_counts(N.flag_anomalies(df)).first()
    assert (counts["flagged"], counts["percent"]) == (0, 0.0)
    empty = N.anomaly_counts(N.flag_anomalies(df.limit(0))).first()
    assert (empty["total"], empty["percent"]) == (0, 0.0)


def test_limits_come_back_by_broadcast(spark):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select(
        F.hour("ts").alias("hour"), (F.weekday("ts") >= 5).cast("int").alias("is_weekend"),
        F.col("value").alias(S.TARGET),
    )
    plan = N.flag_anomalies(events)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


# --- distribution and association --------------------------------------------------------------


def test_distribution_facts_match_pandas(series):
    s = series.select(S.TARGET).toPandas()[S.TARGET]
    for distributed in (True, False):
        r = D.distribution_facts(series, distributed=distributed).first()
        assert (r["mean"], r["median"], r["std"], r["skewness"], r["q1"]) == (
            pytest.approx(s.mean()), s.median(), pytest.approx(s.std()), pytest.approx(s.skew()),
            pytest.approx(s.quantile(0.25)))
        assert r["below_q1_pct"] == pytest.approx(100 * (s < s.quantile(0.25)).mean())


@pytest.mark.parametrize("values", [[3, 3, 3], [1, 2], [0, 1, 5, 5, 9]])
def test_skewness(spark, values):
    got = volumes(spark, values).agg(adjusted_skewness(S.TARGET)).first()[0]
    want = pd.Series(values, dtype=float).skew()
    assert got is None if math.isnan(want) else got == pytest.approx(want)


@pytest.mark.parametrize("values", [[4, 4, 4], [0, 10], [1, 2, 2, 3, 3, 3, 9], list(range(101))])
def test_histogram_matches_numpy(spark, values):
    rows = D.histogram(volumes(spark, values), 20).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=20)
    assert [r["count"] for r in rows] == list(counts)
    assert [r["lower_edge"] for r in rows] == pytest.approx(list(edges[:-1]))


def test_peaks_match_convolution(series):
    s = series.select(S.TARGET).toPandas()[S.TARGET]
    counts, _ = np.histogram(s, bins=20)
    smooth = np.convolve(counts, np.ones(3) / 3, mode="same")
    inner = range(1, 19)
    want = sum(smooth[i] > smooth[i - 1] and smooth[i] > smooth[i + 1] and smooth[i] > 0.3 * smooth.max() for i in inner)
    assert D.peak_count(series).first()["peaks"] == want


def test_pearson_undefined_cases(spark):
    df = volumes(spark, [1, 2, 3, 4], flat=[0.1] * 4, half=[1.0, 2.0, None, None], up=[2.0, 4.0, 6.0, 9.0])
    df = df.select(S.TARGET, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("flat", "half", "up")])
    for parts in (1, 3, 7):
        r = df.repartition(parts).agg(
            pearson("flat", S.TARGET).alias("flat"), pearson("half", S.TARGET).alias("half"),
            pearson("up", S.TARGET).alias("up"),
        ).first()
        assert r["flat"] is None and r["half"] == pytest.approx(1.0)
        assert r["up"] == pytest.approx(np.corrcoef([1, 2, 3, 4], [2, 4, 6, 9])[0, 1])
    table = {r["column"]: r for r in M.correlations_with(df, ["flat", "up"]).collect()}
    assert (table["flat"]["strength"], table["up"]["strength"]) == ("undefined", "strong")


def test_strength_bands(spark):
    df = spark.createDataFrame([(v,) for v in (0.09, -0.1, 0.3, -0.5, None)], "r double")
    assert [r[0] for r in df.select(strength("r")).collect()] == [
        "very weak", "weak", "moderate", "strong", "undefined"]


def test_matrix_matches_pandas(series):
    columns = S.CORRELATION_COLUMNS
    want = series.select(*columns).toPandas().corr()
    got = {(r["a"], r["b"]): r["r"] for r in M.correlation_matrix(series).collect()}
    assert len(got) == 100
    for a in columns:
        for b in columns:
            if math.isnan(want.loc[a, b]):
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(want.loc[a, b], abs=1e-9)
    top = M.top_correlations(M.correlation_matrix(series)).collect()
    assert len(top) == 3 and abs(top[0]["r"]) >= abs(top[1]["r"]) >= abs(top[2]["r"])
    assert M.rounded_matrix(M.correlation_matrix(series)).where("r > 1").count() == 0


def test_matrix_with_an_empty_column(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    got = {(r["a"], r["b"]): r["r"] for r in M.correlation_matrix(df, ["a", "b"]).collect()}
    assert got == {("a", "a"): 1.0, ("a", "b"): None, ("b", "a"): None, ("b", "b"): None}


@pytest.mark.parametrize("distributed", [True, False])
@pytest.mark.parametrize("values", [
    np.random.default_rng(1).normal(size=700),
    np.random.default_rng(2).integers(0, 11, 400),
    np.concatenate([np.zeros(300), np.arange(1, 60)]),
])
def test_trend_matches_qcut(spark, values, distributed):
    y = np.arange(len(values), dtype=float)
    df = volumes(spark, y, x=np.asarray(values, float))
    x = pd.Series(np.asarray(values, float))
    bins = pd.qcut(x, q=min(12, x.nunique()), duplicates="drop")
    want = pd.DataFrame({"x": x, "y": y}).groupby(bins, observed=True).agg(x=("x", "mean"), y=("y", "mean"), n=("y", "size"))
    got = M.quantile_trend(df, "x", distributed=distributed).orderBy("bin").collect()
    assert [r["n"] for r in got] == list(want["n"])
    assert [r["mean_x"] for r in got] == pytest.approx(list(want["x"]))
    assert [r["mean_y"] for r in got] == pytest.approx(list(want["y"]))


def test_trend_needs_more_than_ten_values(spark):
    df = volumes(spark, range(100), x=[float(i % 10) for i in range(100)])
    assert M.quantile_trend(df, "x").count() == 0


# --- sampling, rounding, findings --------------------------------------------------------------


def test_sample_is_exact_and_stable(series):
    first = rows_of(bounded_sample(series, 200, seed=3), S.ROW_ORD)
    again = rows_of(bounded_sample(series.repartition(13), 200, seed=3), S.ROW_ORD)
    assert len(first) == 200 and first == again
    assert first != rows_of(bounded_sample(series, 200, seed=4), S.ROW_ORD)
    assert bounded_sample(series, 10**6).count() == series.count()


@pytest.mark.parametrize("value, digits", [(0.5, 0), (1.5, 0), (2.5, 0), (-0.5, 0), (0.25, 1), (0.35, 1), (1234.567, 2)])
def test_rounding_is_numpys(spark, value, digits):
    got = spark.createDataFrame([(value,)], "v double").select(round_to("v", digits)).first()[0]
    assert got == np.round(value, digits)


def test_rounding_ignores_summation_noise(spark):
    noisy = spark.createDataFrame([(232.49999999999997,), (232.50000000000003,)], "v double")
    assert {r[0] for r in noisy.select(round_to("v")).collect()} == {232.0}


def test_date_label(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-05 00:00:00' AS t")
    assert df.select(date_label("t")).first()[0] == "05 Mar 2024"


def test_findings(series):
    facts = {r["fact"]: r for r in findings.facts(series).collect()}
    assert len(facts) == 11 and facts["busiest_hour"]["label"] == "13:00"
    assert facts["weekday_vs_weekend_pct"]["label"] == "higher"
    assert facts["highest_record"]["value"] == SPIKE
    lines = findings.sentences(findings.facts(series)).orderBy("ord").collect()
    assert len(lines) == 6 and all(r["text"] for r in lines)


def test_findings_without_weekends_and_without_rows(series):
    weekdays = findings.facts(series.where("is_weekend = 0"))
    assert weekdays.count() == 6
    assert findings.sentences(weekdays).count() == 4
    empty = findings.facts(series.limit(0))
    assert [r["fact"] for r in empty.collect()] == ["no_data"]
    assert findings.sentences(empty).count() == 1


def test_profiles_do_not_depend_on_partitioning(series):
    for parts in (1, 17):
        other = series.repartition(parts)
        assert rows_of(A.hourly_profile(other)) == rows_of(A.hourly_profile(series))
        assert rows_of(A.high_traffic_periods(other)) == rows_of(A.high_traffic_periods(series))
        assert rows_of(N.anomaly_table(N.flag_anomalies(other))) == rows_of(N.anomaly_table(N.flag_anomalies(series)))
