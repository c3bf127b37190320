import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from observations import hourly_rows, raw_frame, rows_of
from tidewatch import MissingColumnsError
from tidewatch import schema as S
from tidewatch.operators import regression as R
from tidewatch.operators import segmentation as K
from tidewatch.plans import training
from tidewatch.plans.cleaning import clean
from tidewatch.session import cut_lineage, memory_per_task, release, shared_folder


# --- split -------------------------------------------------------------------------------------


@pytest.mark.parametrize("fraction", [0.05, 0.2, 0.33, 0.5])
def test_split_keeps_time_order(series, fraction):
    split = R.chronological_split(series.repartition(9), fraction)
    train, test = split.train.agg(F.max(S.TIME), F.count("*")).first(), split.test.agg(F.min(S.TIME), F.count("*")).first()
    n = series.count()
    assert train[0] < test[0] == split.cut and split.cut_ord is None
    assert train[1] == int(n * (1 - fraction)) == split.train_rows and train[1] + test[1] == n == split.rows


@pytest.mark.parametrize("fraction", [0.0, 0.04, 0.51, 1.0])
def test_split_checks_the_fraction(series, fraction):
    with pytest.raises(ValueError, match="fraction"):
        R.chronological_split(series, fraction)


def test_split_needs_enough_rows(spark, series):
    small = clean(raw_frame(spark, hourly_rows(2)))
    for df in (small, series.limit(0)):
        with pytest.raises(ValueError, match="[Tt]oo few"):
            R.chronological_split(df)


def test_split_inside_one_second(spark):
    df = spark.range(500).select(
        F.timestamp_micros(F.lit(1_600_000_000_000_000) + F.col("id") * 3).cast("timestamp_ntz").alias(S.TIME)
    )
    split = R.chronological_split(df)
    assert (split.train.count(), split.test.count()) == (400, 100)


def crowded(spark):
    """A thousand rows, the last three hundred of one time."""
    return spark.range(1000).select(
        (F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(hours=F.least("id", F.lit(700)).cast("int"))).alias(S.TIME), "id",
    )


def test_rows_at_the_cut_time_stay_together_without_an_order(spark):
    split = R.chronological_split(crowded(spark).drop("id"))
    assert split.train.count() == 700 == split.train_rows and split.test.count() == 300


@pytest.mark.parametrize("order", ["id * 3 - 5", "struct('f' as file, 0L as block, id * 7000000000 as line)", "struct(CAST(id % 2 AS STRING) as file, id as line)"])
def test_the_cut_is_exact_among_rows_of_one_time(spark, order):
    df = crowded(spark).withColumn(S.ROW_ORD, F.expr(order))
    split = R.chronological_split(df.repartition(7))
    assert split.train.count() == 800 == split.train_rows and split.test.count() == 200
    last = split.train.agg(F.max(F.struct(S.TIME, S.ROW_ORD))).first()[0]
    first = split.test.agg(F.min(F.struct(S.TIME, S.ROW_ORD))).first()[0]
    assert last < first
    labels = {r["part"]: r["count"] for r in R.label_split(df, split).groupBy("part").count().collect()}
    assert labels == {"train": 800, "test": 200}


def test_one_time_cannot_be_split(spark):
    df = crowded(spark).withColumn(S.TIME, F.lit("2020-01-01").cast("timestamp_ntz")).withColumn(S.ROW_ORD, F.col("id"))
    for table in (df, df.drop(S.ROW_ORD)):
        with pytest.raises(ValueError, match="one time"):
            R.chronological_split(table)


# --- preparation -------------------------------------------------------------------------------


def test_target_is_not_a_feature():
    assert S.TARGET not in R.FEATURES and S.TIME not in R.FEATURES


def test_preparation_is_fitted_on_train_only(series):
    split = R.chronological_split(series)
    disturbed = series.withColumn("temp_c", F.when(F.col(S.TIME) >= F.lit(split.cut), 999.0).otherwise(F.col("temp_c")))
    other = R.chronological_split(disturbed)
    assert R.impute_values(split.train).first() == R.impute_values(other.train).first()
    sql = [R.fit_preparation(s.train).stages[0].getStatement() for s in (split, other)]
    assert sql[0] == sql[1]


def test_imputation_values(spark):
    rows = [(1, 0, 1, "b", 1.0, None, 0.0, 5.0), (1, 0, 2, "b", 2.0, None, 0.0, None),
            (2, 0, 2, "a", 9.0, None, 0.0, 7.0), (2, 0, 1, "a", None, None, 0.0, 8.0)]
    df = spark.createDataFrame(rows, "hour int, day_of_week int, month int, weather_main string, "
                                     "temp_c double, rain_1h double, snow_1h double, clouds_all double")
    for distributed in (True, False):
        r = R.impute_values(df, distributed=distributed).first()
        assert (r["hour"], r["day_of_week"], r["month"], r["weather_main"]) == (1, 0, 1, "a")
        assert (r["temp_c"], r["rain_1h"], r["snow_1h"], r["clouds_all"]) == (2.0, 0.0, 0.0, 7.0)


def test_encoding(spark, series):
    train = R.chronological_split(series).train
    prep = R.fit_preparation(train)
    names = R.feature_names(prep)
    row = series.limit(1)
    known = prep.transform(row).first()
    assert len(known["features"]) == len(names)
    hour = known["hour"]
    assert known["features"][names.index(f"hour_{hour}")] == 1.0
    assert sum(known["features"][i] for i, n in enumerate(names) if n.startswith("hour_")) == 1.0
    unseen = prep.transform(row.withColumn("weather_main", F.lit("Ashfall"))).first()
    assert sum(unseen["features"][i] for i, n in enumerate(names) if n.startswith("weather_main_")) == 0.0
    gone = prep.transform(row.withColumn("temp_c", F.lit(None).cast("double"))).first()
    scaled = prep.transform(train).agg(F.avg("temp_c_scaled"), F.stddev_pop("temp_c_scaled"), F.max("rain_1h_scaled")).first()
    assert gone["temp_c_scaled"] is not None
    assert scaled[0] == pytest.approx(0, abs=1e-9) and scaled[1] == pytest.approx(1) and scaled[2] == 0.0


def test_category_text_is_quoted(spark, series):
    odd = series.withColumn("weather_main", F.lit("it's \\ odd"))
    prep = R.fit_preparation(R.chronological_split(odd).train)
    empty = odd.limit(1).withColumn("weather_main", F.lit(None).cast("string"))
    assert prep.transform(empty).first()["weather_main_text"] == "it's \\ odd"


# --- models ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def fitted(series, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("models") / "best")
    return training.train_and_evaluate(series, 0.2, path, trees=20), path


def test_models_beat_the_baseline(fitted):
    table = {r["model"]: r for r in fitted[0].results.collect()}
    assert set(table) == set(R.MODELS)
    for model in (R.LINEAR, R.FOREST):
        assert table[model]["RMSE"] < table[R.BASELINE]["RMSE"] and table[model]["R2"] > 0.5
    assert R.best_model(fitted[0].results).first()["best_model"] == fitted[0].best_model == R.FOREST


def test_metrics_match_numpy(fitted):
    pdf = fitted[0].scored.toPandas()
    table = {r["model"]: r for r in fitted[0].results.collect()}
    for model, column in R.MODELS.items():
        error = pdf[S.TARGET] - pdf[column]
        assert table[model]["MAE"] == pytest.approx(error.abs().mean())
        assert table[model]["RMSE"] == pytest.approx(np.sqrt((error**2).mean()))
        sst = ((pdf[S.TARGET] - pdf[S.TARGET].mean()) ** 2).sum()
        assert table[model]["R2"] == pytest.approx(1 - (error**2).sum() / sst, abs=1e-9)
    long = R.metrics_long(fitted[0].results)
    assert long.count() == 9 and long.columns == ["model", "metric", "value"]
    assert R.shown_metrics(fitted[0].results).count() == 3


def test_linear_model_is_least_squares(fitted, series):
    """Fitted values of the linear model equal NumPy's on the same features."""
    fit = fitted[0]
    train = fit.models[R.LINEAR].transform(fit.split.train).select(S.TARGET, "features", "p_linear").toPandas()
    x = np.column_stack([np.ones(len(train)), np.array([v.toArray() for v in train["features"]])])
    beta, *_ = np.linalg.lstsq(x, train[S.TARGET].to_numpy(), rcond=None)
    assert np.allclose(x @ beta, train["p_linear"], atol=1.0)


def test_predictions_are_not_negative(fitted):
    low = fitted[0].scored.agg(*[F.min(c) for c in R.MODELS.values()]).first()
    assert min(low) >= 0


def test_saved_model_scores_alike(spark, fitted):
    fit, path = fitted
    model, metadata = training.load_model(spark, path)
    assert metadata["model_name"] == fit.best_model and metadata["feature_columns"] == R.FEATURES
    assert metadata["metrics"]["RMSE"] > 0 and metadata["train_period"][1] < metadata["test_period"][0]
    conditions = spark.createDataFrame(
        [(8, 1, 3, "Clear", 10.0, 0.0, 0.0, 40.0, 0), (3, 6, 1, "Unheard of", None, 0.0, 0.0, 40.0, 1)],
        "hour int, day_of_week int, month int, weather_main string, temp_c double, rain_1h double, "
        "snow_1h double, clouds_all double, is_holiday int",
    )
    a = rows_of(R.score(model, conditions, metadata["prediction"]), "hour", "is_weekend", "predicted")
    b = rows_of(R.score(fit.models[fit.best_model], conditions, R.MODELS[fit.best_model]), "hour", "is_weekend", "predicted")
    assert a == b and all(r[2] >= 0 for r in a)
    by_hour = {r[0]: r for r in a}
    assert by_hour[8][1] == 0 and by_hour[3][1] == 1 and by_hour[8][2] > by_hour[3][2]


def test_scoring_fills_in_default_conditions(spark, fitted):
    fit = fitted[0]
    bare = spark.createDataFrame([(8, 1, 1)], "hour int, day_of_week int, month int")
    full = bare.withColumns({c: F.lit(v) for c, v in R.DEFAULT_CONDITIONS.items()})
    model, column = fit.models[R.FOREST], R.MODELS[R.FOREST]
    assert R.score(model, bare, column).first()["predicted"] == R.score(model, full, column).first()["predicted"]
    with pytest.raises(MissingColumnsError):
        R.score(model, bare.drop("month"), column)


def test_no_saved_model(spark, tmp_path):
    assert training.load_model(spark, str(tmp_path / "none")) is None


def test_test_rows_of_one_file_are_scored_by_many_tasks(series):
    fit = training.train_and_evaluate(series.coalesce(1), trees=2, max_depth=2, partitions=4)
    tasks = fit.scored.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 4 and sum(r["count"] for r in tasks) == fit.split.rows - fit.split.train_rows


def test_importances(fitted):
    fit = fitted[0]
    table = fit.importance().collect()
    assert len(table) == 15 and "hour_" in "".join(r["feature"] for r in table)
    assert [r["importance"] for r in table] == sorted((r["importance"] for r in table), reverse=True)
    everything = fit.importance(10**6).agg(F.sum("importance")).first()[0]
    assert everything == pytest.approx(1.0)
    assert R.feature_importance(None, fit.models[R.LINEAR].stages[-1], fit.names) is None


def test_fingerprint_tells_equal_lengths_apart(series):
    other = series.withColumn(S.TARGET, F.when(F.col(S.ROW_ORD) == 5, 1.0).otherwise(F.col(S.TARGET)))
    cooler = series.withColumn("temp_c", F.when(F.col(S.ROW_ORD) != 5, F.col("temp_c")))
    twice = series.union(series.where(f"{S.ROW_ORD} in (3, 4)"))
    marks = [training.fingerprint(df) for df in (series, other, cooler, twice, twice.union(series.where(f"{S.ROW_ORD} = 3")))]
    assert len(set(marks)) == 5 and training.fingerprint(series.repartition(3)) == marks[0]


def test_a_stored_model_knows_its_rows(spark, fitted, series):
    _, metadata = training.load_model(spark, fitted[1])
    assert training.is_current(metadata, series) and not training.is_current(metadata, series.where("hour > 0"))


def test_views(fitted):
    scored = fitted[0].scored
    start = str(fitted[0].split.cut)[:10]
    assert R.window_view(scored, "p_forest", start, 30).count() == scored.count()
    assert 0 < R.window_view(scored, "p_forest", start, 2).count() <= 48
    with pytest.raises(ValueError):
        R.window_view(scored, "p_forest", start, 31)
    sample = R.residual_sample(scored, "p_forest", 50).toPandas()
    assert len(sample) == 50
    assert sample["axis_max"].iloc[0] == max(sample["actual"].max(), sample["predicted"].max())


def test_the_forest_has_one_depth_for_all_sizes():
    assert R.random_forest().getMaxDepth() == R.MAX_DEPTH and R.random_forest(max_depth=30).getMaxDepth() == 30


def test_training_needs_its_columns(series):
    with pytest.raises(MissingColumnsError):
        training.train_and_evaluate(series.drop("clouds_all"))


# --- segmentation ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def segments(series):
    return K.run_kmeans(series, restarts=3)


def test_clusters(segments, series):
    summary = segments.summary.orderBy("cluster").collect()
    assert [r["cluster"] for r in summary] == [0, 1, 2, 3]
    assert sum(r["observations"] for r in summary) == segments.rows.count() == series.count()
    volumes = [r["avg_traffic"] for r in summary]
    assert volumes == sorted(volumes)
    assert all("most often at" in r["description"] for r in summary)
    assert set(series.columns) <= set(segments.rows.columns)
    assert 0.05 < segments.silhouette.first()["silhouette"] <= 1


def test_every_row_is_with_its_nearest_centre(segments):
    pdf = K.standardise(segments.rows).toPandas()
    x, labels = pdf[[f"z_{c}" for c in K.FEATURES]].to_numpy(), pdf["cluster"].to_numpy()
    centres = np.array([x[labels == i].mean(axis=0) for i in range(4)])
    distance = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(-1)
    assert (distance.argmin(axis=1) == labels).mean() > 0.995
    assert distance[np.arange(len(x)), labels].sum() == pytest.approx(segments.cost, rel=0.01)


def test_more_restarts_never_cost_more(series, segments):
    assert segments.cost <= K.run_kmeans(series, restarts=1).cost + 1e-9


def test_too_few_rows_to_cluster(series):
    with pytest.raises(ValueError, match="[Tt]oo few"):
        K.run_kmeans(series.limit(39))


def test_incomplete_rows_are_left_out(series):
    holes = series.withColumn("temp_c", F.when(F.col("hour") > 3, F.col("temp_c")))
    assert K.cluster_features(holes).where("hour <= 3").count() == 0


def silhouette_by_hand(x, labels):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    scores = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            scores.append(0.0)
            continue
        a = d[i][same].sum() / (same.sum() - 1)
        b = min(d[i][labels == other].mean() for other in set(labels) - {own})
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


def test_silhouette_matches_its_definition(series):
    labelled = K.cluster_features(series).withColumn(
        "cluster", F.when(F.col(S.ROW_ORD) == 7, 9).otherwise((F.col("hour") / 9).cast("int"))
    )
    pdf = K.standardise(labelled).toPandas()
    want = silhouette_by_hand(pdf[[f"z_{c}" for c in K.FEATURES]].to_numpy(), pdf["cluster"].to_numpy())
    got = K.silhouette(labelled).first()
    assert got["points"] == len(pdf) and got["silhouette"] == pytest.approx(want, abs=1e-7)
    assert K.silhouette(labelled, 300).first()["points"] == 300
    assert K.silhouette(labelled.withColumn("cluster", F.lit(1))).first()["silhouette"] is None
    with pytest.raises(ValueError, match="limited"):
        K.silhouette(labelled, 10**6)


def test_standardise_handles_constants(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": [1.0, 2.0, 3.0], "b": [0.1] * 3})).repartition(3)
    got = K.standardise(df, ["a", "b"]).toPandas()
    assert got["z_b"].tolist() == [0.0] * 3
    assert got["z_a"].std(ddof=0) == pytest.approx(1)


def test_cluster_points(segments):
    points = K.cluster_points(segments.rows, 100)
    assert points.count() == 100
    assert {r["day_type"] for r in points.collect()} == {"Weekday", "Weekend"}


# --- shared folder -----------------------------------------------------------------------------


def test_lineage_is_cut_into_the_named_folder(spark, series):
    table = cut_lineage(series.select(S.ROW_ORD, S.TARGET))
    assert table.count() == series.count()
    assert all(shared_folder(spark).replace("file:", "") in f for f in table.inputFiles())
    release(table)
    with pytest.raises(Exception, match="(?i)not.*exist"):
        table.count()


def test_checkpoints_go_to_the_shared_folder(spark):
    assert spark.sparkContext.getCheckpointDir() and shared_folder(spark)


def test_the_silhouette_waits_until_asked(segments):
    assert "silhouette" not in K.run_kmeans.__code__.co_names
    assert segments.rows.inputFiles()  # labels are stored, not recomputed


@pytest.mark.parametrize("memory, megabytes", [("1g", 128), ("16g", 2048), ("2048m", 256), ("2147483648", 256)])
def test_memory_per_task(spark, memory, megabytes):
    class Context:
        master, defaultParallelism = "local[8]", 8

        @staticmethod
        def getConf():
            return {"spark.driver.memory": memory}

    class Session:
        sparkContext = Context

    assert memory_per_task(Session) == megabytes
    assert R.random_forest(task_memory=128).getMaxMemoryInMB() == 32
    assert R.random_forest().getMaxMemoryInMB() == 512
