"""One runnable query per operator, over the whole of the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import schema as S
from tidewatch.functions.quantiles import exact_quantiles
from tidewatch.functions.sampling import bounded_sample
from tidewatch.functions.scalars import blank_missing, round_to
from tidewatch.operators import anomalies as N
from tidewatch.operators import association as M
from tidewatch.operators import cleaning as C
from tidewatch.operators import distribution as D
from tidewatch.operators import peaks as P
from tidewatch.operators import profiles as A
from tidewatch.operators import quality as Q
from tidewatch.operators import regression as R
from tidewatch.operators import segmentation as K
from tidewatch.plans import cleaning, findings, training
from tidewatch.session import shared_folder
from tidewatch.sources import tables
from tidewatch.sources.readers import preview, read_raw_csv
from tidewatch.sources.writers import write_rows

CLEAN_COLUMNS = [
    S.ROW_ORD, *S.REQUIRED_COLUMNS, "temp_c", "hour", "day", "month", "year", "day_of_week",
    "day_name", "month_name", "is_weekend", "is_holiday", "date",
]


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at a fixed number of decimals: sums differ in their last bits from run to run."""
    return df.select(*[
        (round_to(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema
    ])


def _raw(spark, folder):
    return tables.raw_observations(spark, folder)


def _scan(spark, folder):
    raw = _raw(spark, folder)
    return raw.withColumns({
        f.name: blank_missing(F.col(f.name))
        for f in raw.schema if isinstance(f.dataType, T.StringType)
    })


def _csv_back(spark, folder, packed: bool):
    """All events as raw records, written as CSV into the shared folder and read back.

    Descriptions get line breaks and quotes, so that records span lines.
    """
    raw = _raw(spark, folder)
    breaks = F.concat(F.lit('"'), F.col("weather_description"), F.lit('"\n, '), F.col(S.ROW_ORD).cast("string"))
    texts = raw.select(
        *[F.col(c) for c in S.REQUIRED_COLUMNS if c != "weather_description"],
        F.when(F.col(S.ROW_ORD) % 3 == 0, breaks).otherwise(F.col("weather_description")).alias("weather_description"),
        F.col(S.ROW_ORD).alias("number"))
    path = f"{shared_folder(spark)}/tidewatch/{spark.sparkContext.applicationId}/csv-{uuid.uuid4()}"
    write_rows(texts, path, "csv", compression="gzip" if packed else None)
    back = read_raw_csv(spark, path)
    numbers = {"temp", "rain_1h", "snow_1h", "clouds_all", S.TARGET}
    return back.select(
        F.col("number").cast("long").alias(S.ROW_ORD),
        *[(F.col(c).cast("double") if c in numbers else F.col(c)).alias(c) for c in S.REQUIRED_COLUMNS])


def _valid(spark, folder):
    return cleaning.parse(_raw(spark, folder)).transform(C.valid_rows)


def _firsts(spark, folder):
    return _valid(spark, folder).transform(C.first_per_time)


def _clean(spark, folder):
    return cleaning.clean(_raw(spark, folder)).select(*CLEAN_COLUMNS)


def _obs(spark, folder):
    return tables.event_observations(spark, folder)


def _busy_hours(spark, folder):
    """Hours of day whose mean volume is above the overall mean."""
    obs = _obs(spark, folder)
    overall = obs.agg(F.avg(S.TARGET).alias("m")).scalar()
    means = obs.groupBy("hour").agg(F.avg(S.TARGET).alias("mean"))
    return means.where(F.col("mean") > overall)


def _flag(spark, folder, keys=tuple(S.ANOMALY_GROUP), **options):
    return N.flag_anomalies(tables.event_observations(spark, folder, **options), keys)


def _flag_columns(df: DataFrame) -> DataFrame:
    return df.select(S.ROW_ORD, "lower_limit", "upper_limit", "is_anomaly", "anomaly_type")


def _line_flags(spark, folder):
    keys = ["l_returnflag", "l_linestatus"]
    flagged = N.flag_anomalies(tables.line_items(spark, folder), keys)
    return flagged.groupBy(*keys, "lower_limit", "upper_limit", "anomaly_type").agg(
        F.count(F.lit(1)).alias("count")
    )


def _rows_by_part(spark, folder):
    obs = _obs(spark, folder)
    return R.label_split(obs, R.chronological_split(obs))


def _baseline(spark, folder):
    split = R.chronological_split(_obs(spark, folder))
    return R.baseline_predictions(split.train, split.test)


def _fixed_labels(spark, folder):
    """Observations with a label that follows from the calendar."""
    label = F.col("is_weekend") * 2 + (F.col("hour") >= 12).cast("int")
    return K.cluster_features(_obs(spark, folder)).withColumn("cluster", label)


_FITS: dict[str, tuple] = {}


def _fit_once(kind: str, spark: SparkSession, folder: str, fit):
    """Fitted once per session and content of the input; several queries show parts of it.

    Only the last fit of a kind is held.
    """
    obs = _obs(spark, folder)
    key = (spark.sparkContext.applicationId, training.fingerprint(tables.load(spark, folder, "events")))
    if _FITS.get(kind, (None,))[0] != key:
        if kind in _FITS and hasattr(_FITS[kind][1], "scored"):
            _FITS[kind][1].scored.unpersist()
        _FITS[kind] = (key, fit(obs))
    return _FITS[kind][1]


def segments(spark: SparkSession, folder: str) -> K.Segmentation:
    columns = [S.ROW_ORD, S.TIME, *K.BASE_COLUMNS]
    return _fit_once("segments", spark, folder, lambda obs: K.run_kmeans(obs.select(*columns)))


def trained(spark: SparkSession, folder: str) -> training.Training:
    return _fit_once("models", spark, folder, training.train_and_evaluate)


def _conditions(spark, folder):
    """Typical weather per hour, weekday and condition, to be scored as a batch."""
    return _obs(spark, folder).groupBy("hour", "day_of_week", "month", "weather_main").agg(
        *[F.avg(c).alias(c) for c in R.NUMERIC], F.max("is_holiday").alias("is_holiday")
    )


def _scored_conditions(spark, folder):
    fit = trained(spark, folder)
    return R.score(
        fit.models[fit.best_model], _conditions(spark, folder), R.MODELS[fit.best_model]
    )


def _metrics_of(spark, folder, model):
    return trained(spark, folder).results.where(F.col("model") == model)


def _fixed_predictions(spark, folder):
    """Test rows with predictions that follow from the calendar, in the place of fitted ones."""
    hour, weekend = F.col("hour").cast("double"), F.col("is_weekend").cast("double")
    return _baseline(spark, folder).withColumns({
        R.MODELS[R.LINEAR]: F.lit(400.0) + F.lit(10.0) * hour,
        R.MODELS[R.FOREST]: F.lit(500.0) - F.lit(80.0) * weekend,
    })


def _score_fixed(spark, folder):
    """Scoring by a pipeline with given coefficients; one prediction is negative and gets clipped."""
    statement = "SELECT *, 25 * hour - 40 * day_of_week + 2 * temp_c - 60 * is_weekend - 100 AS p_fixed FROM __THIS__"
    model = PipelineModel(stages=[SQLTransformer(statement=statement)])
    hours = _obs(spark, folder).groupBy("hour", "day_of_week", "month").agg(F.count(F.lit(1)).alias("n"))
    return R.score(model, hours, "p_fixed")


def _segment_checks(spark, folder):
    """What must hold of any clustering; every column is 0 but the number of clusters."""
    fit = segments(spark, folder)
    complete = K.cluster_features(_obs(spark, folder)).agg(F.count(F.lit(1)).alias("complete"))
    pairs = fit.model.transform(K.standardise(fit.rows)).groupBy("cluster", "prediction").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(S.TARGET).alias("mean"))
    order = Window.orderBy("cluster")
    steps = pairs.withColumn("before", F.lag("mean").over(order))  # one row per cluster
    found = steps.agg(
        F.count_distinct("cluster").alias("clusters"), (F.count(F.lit(1)) - F.count_distinct("prediction")).alias("mixed_labels"),
        F.sum("rows").alias("rows"), F.count_if(F.col("before") > F.col("mean")).alias("out_of_order"))
    sizes = fit.summary.agg(F.sum("observations").alias("in_summary"), F.count_if(F.col("description").isNull()).alias("undescribed"))
    points = K.cluster_points(fit.rows).agg(F.count(F.lit(1)).alias("points"))
    row = found.withColumns({
        "complete": complete.scalar(), "in_summary": sizes.select("in_summary").scalar(),
        "undescribed": sizes.select("undescribed").scalar(), "points": points.scalar(),
    })
    return row.select(
        "clusters", "mixed_labels", "out_of_order", "undescribed", (F.col("complete") - F.col("rows")).alias("rows_lost"),
        (F.col("rows") - F.col("in_summary")).alias("summary_lost"), (F.least("rows", F.lit(6000)) - F.col("points")).alias("points_lost"))


def _linear_checks(spark, folder):
    """Residuals of least squares are orthogonal to every numeric and binary feature: features for which they are not."""
    fit = trained(spark, folder)
    linear = fit.models[R.LINEAR].transform(fit.split.train)
    error = F.col(S.TARGET) - F.col(R.MODELS[R.LINEAR])
    features = [f"{c}_scaled" for c in R.NUMERIC] + R.BINARY
    scale = F.stddev_pop(S.TARGET)
    wide = linear.agg(*[(F.abs(F.avg(error * F.col(c))) > F.lit(1e-3) * scale).cast("int").alias(c) for c in features])
    return wide.select(sum((F.col(c) for c in features[1:]), F.col(features[0])).alias("violations"))


def _forest_checks(spark, folder):
    """On a target that follows the calendar: 1 where the forest does what it must."""
    hour, weekend = F.col("hour"), F.col("is_weekend")
    target = F.lit(200.0) + F.abs(hour - 12) * F.lit(90.0) + weekend * F.lit(500.0)
    obs = _obs(spark, folder).withColumn(S.TARGET, target)
    one, two = (training.train_and_evaluate(obs, trees=5, max_depth=8) for _ in range(2))
    errors = one.results.groupBy().pivot("model", list(R.MODELS)).agg(F.first("RMSE"))
    low = one.scored.agg(F.min(R.MODELS[R.FOREST]).alias("low"))
    again = two.results.where(F.col("model") == R.FOREST).select("RMSE")
    return errors.select(
        (F.col(R.FOREST) < F.lit(0.5) * F.col(R.BASELINE)).cast("int").alias("beats_baseline"),
        (low.scalar() >= 0).cast("int").alias("never_negative"),
        (F.abs(F.col(R.FOREST) - again.scalar()) < 1e-9).cast("int").alias("same_twice"))


def _importance_checks(spark, folder):
    """All importances add up to one, none is negative."""
    every = trained(spark, folder).importance(10**6)
    return every.agg(
        round_to(F.sum("importance"), 6).alias("total"), F.count_if(F.col("importance") < 0).alias("negative"))


def _split_with_ties(spark, folder):
    obs = tables.order_observations(spark, folder)
    return R.label_split(obs, R.chronological_split(obs)).select(S.ROW_ORD, S.TIME, "part")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        # sources
        "s1_scan_raw": _scan,
        "s1_read_csv": lambda s, d: _csv_back(s, d, packed=False),
        "s1_read_csv_gz": lambda s, d: _csv_back(s, d, packed=True),
        "s7_preview": lambda s, d: preview(_raw(s, d)),
        # quality
        "q1_describe": lambda s, d: Q.describe_columns(_scan(s, d), S.REQUIRED_COLUMNS),
        "q2_outlier_summary": lambda s, d: Q.outlier_summary(_obs(s, d)),
        "q2_outlier_summary_lineitem": lambda s, d: Q.outlier_summary(
            tables.load(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
        ),
        "q3_missing_after": lambda s, d: Q.remaining_missing(_clean(s, d)),
        "q4_time_gaps": lambda s, d: Q.time_gaps(_clean(s, d)),
        "q6_clean_report": lambda s, d: cleaning.report(_raw(s, d)),
        "q7_steps": lambda s, d: cleaning.steps(_raw(s, d)),
        # cleaning
        "c1_parse_dates": lambda s, d: _raw(s, d).transform(C.parse_dates).select(S.ROW_ORD, S.TIME),
        "c2_coerce": lambda s, d: _raw(s, d).transform(C.coerce_numbers).select(S.ROW_ORD, *S.NUMERIC_COLUMNS),
        "c3_valid_target": lambda s, d: _valid(s, d).select(S.ROW_ORD, S.TIME, S.TARGET),
        "c4_holiday_labels": lambda s, d: C.holiday_labels(_valid(s, d)).withColumn(
            "day", F.col("day").cast("timestamp_ntz")
        ),
        "c5_exact_dups": lambda s, d: C.distinct_rows(_valid(s, d)).agg(
            F.count(F.lit(1)).alias("distinct_rows"),
            F.sum(F.col("copies") - 1).alias("exact_duplicates"),
        ),
        "c6_one_per_ts": lambda s, d: _firsts(s, d).select(S.ROW_ORD, S.TIME, "temp", S.TARGET),
        "c7_spread_holiday": lambda s, d: _firsts(s, d).transform(
            C.spread_labels, C.holiday_labels(_valid(s, d))
        ).select(S.ROW_ORD, S.TIME, "holiday", "weather_main", "weather_description"),
        "c8_bounds": lambda s, d: _firsts(s, d).transform(C.apply_bounds).select(
            S.ROW_ORD, *S.LIMITS
        ),
        "c8_invalid_counts": lambda s, d: C.invalid_counts(_firsts(s, d)),
        "c9_features": lambda s, d: shown(_clean(s, d).select(
            S.ROW_ORD, "temp_c", "hour", "day", "month", "year", "day_of_week", "day_name",
            "month_name", "is_weekend", "is_holiday", "date",
        )),
        "c10_clean": lambda s, d: shown(_clean(s, d)),
        "c11_date_filter": lambda s, d: C.filter_by_date(
            tables.event_observations(s, d), "2024-01-05", "2024-01-12"
        ).select(S.ROW_ORD, S.TIME, S.TARGET),
        "c12_bounds": lambda s, d: C.date_bounds(_obs(s, d)),
        # profiles
        "a1_hourly_profile": lambda s, d: shown(A.hourly_profile(_obs(s, d))),
        "a2_dow_profile": lambda s, d: A.day_of_week_profile(_obs(s, d)),
        "a3_daytype_profile": lambda s, d: A.day_type_profile(_obs(s, d)),
        "a4_high_periods": lambda s, d: shown(A.high_traffic_periods(_obs(s, d))),
        "a5_hour_mean_std": lambda s, d: shown(A.hour_spread(_obs(s, d))),
        "a5_hour_extremes": lambda s, d: shown(A.hour_extremes(_obs(s, d))),
        "a6_day_dense": lambda s, d: shown(A.day_dense(_obs(s, d))),
        "a6_day_extremes": lambda s, d: shown(A.day_extremes(_obs(s, d))),
        "a7_month_dense": lambda s, d: shown(A.month_dense(tables.order_observations(s, d))),
        "a7_month_extremes": lambda s, d: shown(A.month_extremes(tables.order_observations(s, d))),
        "a8_heatmap": lambda s, d: shown(A.heatmap(_obs(s, d))),
        "a8_heatmap_extremes": lambda s, d: shown(A.heatmap_extremes(_obs(s, d))),
        "a9_category_profile": lambda s, d: shown(A.category_profile(_obs(s, d))),
        "a9_category_extremes": lambda s, d: shown(A.category_extremes(_obs(s, d))),
        "a10_kpis": lambda s, d: shown(A.kpis(_obs(s, d))),
        "a12_anomaly_by_hour": lambda s, d: N.anomalies_by_hour(_flag(s, d)),
        "a13_daytype_diff": lambda s, d: shown(A.day_type_difference(_obs(s, d))),
        "a14_categories": lambda s, d: A.categories(_obs(s, d)),
        # top-k and samples
        "t1_top_hours": lambda s, d: shown(P.top_hours(_obs(s, d))),
        "t2_top_observations": lambda s, d: P.top_observations(_obs(s, d)),
        "t4_peak_by_daytype": lambda s, d: P.peak_by_day_type(_obs(s, d)),
        "t5_anomaly_table": lambda s, d: N.anomaly_table(_flag(s, d)),
        "t5_anomaly_table_top": lambda s, d: N.anomaly_table(_flag(s, d), 500),
        "t6_sample": lambda s, d: bounded_sample(_obs(s, d).select(S.ROW_ORD, S.TIME, S.TARGET), 4_000),
        "t6_weather_scatter": lambda s, d: shown(M.scatter_sample(_obs(s, d), "temp_c")),
        # distribution and association
        "m1_distribution": lambda s, d: shown(D.distribution_facts(_obs(s, d))),
        "m2_histogram": lambda s, d: shown(D.histogram(_obs(s, d))),
        "m2_histogram_display": lambda s, d: shown(D.histogram(_obs(s, d), 50)),
        "m3_peaks": lambda s, d: D.peak_count(_obs(s, d)),
        "m4_pearson": lambda s, d: shown(M.correlations_with(_obs(s, d))),
        "m4_pearson_lineitem": lambda s, d: shown(M.correlations_with(
            tables.line_items(s, d), ["l_quantity", "l_discount", "l_tax"]
        )),
        "m5_quantile_trend": lambda s, d: shown(M.quantile_trend(_obs(s, d), "temp_c")),
        "m6_corr_matrix": lambda s, d: shown(M.correlation_matrix(_obs(s, d))),
        "m6_corr_matrix_lineitem": lambda s, d: shown(M.correlation_matrix(
            tables.load(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
        )),
        "m7_top_corr": lambda s, d: shown(M.top_correlations(M.correlation_matrix(_obs(s, d)))),
        "m8_quantiles": lambda s, d: shown(exact_quantiles(_obs(s, d), S.TARGET, [0.25, 0.5, 0.75]).select(
            "n", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75))]
        )),
        "m8_quantiles_distributed": lambda s, d: shown(exact_quantiles(
            tables.line_items(s, d), S.TARGET, [0.01, 0.25, 0.5, 0.75, 0.99],
            ["l_returnflag"], distributed=True,
        ).select(
            "l_returnflag", "n",
            *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((1, 25, 50, 75, 99))]
        )),
        # anomalies
        "n1_iqr": lambda s, d: shown(_flag_columns(_flag(s, d))),
        "n1_iqr_low_side": lambda s, d: shown(_flag_columns(_flag(s, d, log_volume=True))),
        "n1_iqr_lineitem": lambda s, d: shown(_line_flags(s, d)),
        "n2_iqr_global": lambda s, d: shown(_flag_columns(_flag(s, d, ()))),
        "n3_anomaly_counts": lambda s, d: N.anomaly_counts(_flag(s, d)),
        "n4_series_high": lambda s, d: N.anomaly_series(_flag(s, d), "High"),
        # findings
        "x15_hour_ranges": lambda s, d: P.hour_ranges(_busy_hours(s, d)),
        "x15_high_hour_ranges": lambda s, d: P.high_hour_ranges(_obs(s, d)),
        "f1_findings": lambda s, d: shown(findings.facts(_obs(s, d))),
        "f1_sentences": lambda s, d: findings.sentences(findings.facts(_obs(s, d))),
        # segmentation
        "k1_features": lambda s, d: shown(K.cluster_features(_obs(s, d)).select(S.ROW_ORD, *K.FEATURES)),
        "k2_clusters": lambda s, d: segments(s, d).rows.select(
            S.ROW_ORD, S.TIME, S.TARGET, "hour", "is_weekend", "cluster"
        ),
        "k3_summary": lambda s, d: K.cluster_summary(segments(s, d).rows),
        "k3_summary_fixed_labels": lambda s, d: K.cluster_summary(_fixed_labels(s, d)),
        "f2_cluster_labels": lambda s, d: segments(s, d).summary,
        "f2_labels_fixed": lambda s, d: K.describe(_fixed_labels(s, d)).select(
            "cluster", "observations", "common_hours", "description"
        ),
        "f2_common_hours": lambda s, d: K.common_hours(_fixed_labels(s, d)),
        "k4_silhouette": lambda s, d: shown(K.silhouette(_fixed_labels(s, d))),
        "k4_silhouette_fit": lambda s, d: segments(s, d).silhouette,
        "k5_points_fixed_labels": lambda s, d: shown(K.cluster_points(_fixed_labels(s, d))),
        "k5_cluster_points": lambda s, d: K.cluster_points(segments(s, d).rows),
        # regression
        "k2_checks": _segment_checks,
        "l1_split_ties": _split_with_ties,
        "l4_checks": _linear_checks,
        "l5_checks": _forest_checks,
        "l7_best_fixed": lambda s, d: shown(R.best_model(R.metrics(_fixed_predictions(s, d)))),
        "l9_score_fixed": lambda s, d: shown(_score_fixed(s, d).select("hour", "day_of_week", "month", "n", "is_weekend", "predicted")),
        "l10_importance_checks": _importance_checks,
        "l11_metrics_fixed": lambda s, d: shown(R.metrics_long(R.metrics(_fixed_predictions(s, d)))),
        "l1_split": lambda s, d: _rows_by_part(s, d).select(S.ROW_ORD, S.TIME, "part"),
        "l2_impute_stats": lambda s, d: shown(R.impute_values(R.chronological_split(_obs(s, d)).train)),
        "l3_baseline": lambda s, d: shown(_baseline(s, d).select(S.ROW_ORD, S.TARGET, "p_baseline")),
        "l4_linear": lambda s, d: _metrics_of(s, d, R.LINEAR),
        "l5_forest": lambda s, d: _metrics_of(s, d, R.FOREST),
        "l6_metrics": lambda s, d: shown(R.metrics(_baseline(s, d))),
        "l7_best": lambda s, d: R.best_model(trained(s, d).results),
        "l9_score": _scored_conditions,
        "l10_importance": lambda s, d: trained(s, d).importance(),
        "l11_metrics_long": lambda s, d: R.metrics_long(trained(s, d).results),
        "l12_window_view": lambda s, d: shown(R.window_view(_baseline(s, d), "p_baseline", "2024-01-25", 3)),
        "l13_split_facts": lambda s, d: R.split_facts(_rows_by_part(s, d)),
        "l13_shown_metrics": lambda s, d: R.shown_metrics(R.metrics(_baseline(s, d))),
        "l14_residual_sample": lambda s, d: shown(R.residual_sample(_baseline(s, d), "p_baseline")),
    }
    for period in ("hourly", "daily", "weekly", "monthly"):
        q[f"a11_resample_{period}"] = lambda s, d, p=period: shown(
            A.resample(tables.order_observations(s, d), p)
        )
        q[f"a11_facts_{period}"] = lambda s, d, p=period: A.resample_facts(
            tables.order_observations(s, d), p
        )
    return q
