"""Chronological split, leakage-free preparation, models and their evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler,
)
from pyspark.ml.regression import (
    LinearRegression, RandomForestRegressionModel, RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import schema as S
from tidewatch.functions.attach import with_row
from tidewatch.functions.quantiles import column_quantiles
from tidewatch.functions.sampling import bounded_sample
from tidewatch.functions.scalars import ntz, round_to
from tidewatch.session import cut_lineage, release

# The inputs of the models.
CATEGORICAL = ["hour", "day_of_week", "month", "weather_main"]
NUMERIC = ["temp_c", "rain_1h", "snow_1h", "clouds_all"]
BINARY = ["is_weekend", "is_holiday"]
FEATURES = CATEGORICAL + NUMERIC + BINARY

BASELINE, LINEAR, FOREST = "Baseline (training mean)", "Linear Regression", "Random Forest"
MODELS = {BASELINE: "p_baseline", LINEAR: "p_linear", FOREST: "p_forest"}

# --- split -----------------------------------------------------------------------------------


@dataclass
class Split:
    train: DataFrame
    test: DataFrame
    cut: object  # first timestamp of the test part
    cut_ord: object  # its first row, where several rows share that timestamp; else None
    rows: int
    train_rows: int


def _bucket_at(df: DataFrame, bucket: Column, rank) -> dict | None:
    """The bucket that holds 0-based ``rank`` of the order, and the rows before it.

    Counts per bucket come from a map-side combined aggregate; the running total runs over
    the buckets only. ``rank`` may be a number or a function of the total.
    """
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket")) - F.col("n")
    placed = counts.select(
        "bucket", "n", before.alias("before"), F.sum("n").over(Window.partitionBy()).alias("total")
    )
    target = rank(F.col("total")) if callable(rank) else F.lit(rank)
    hit = (F.col("before") <= target) & (target < F.col("before") + F.col("n"))
    row = placed.withColumn("rank", target).where(hit).first()
    return row.asDict() if row else None


def _far_bucket_at(df: DataFrame, bucket: Column, rank: int) -> dict:
    """As :func:`_bucket_at` for buckets of any number, such as file names.

    A prefix sum in parts: buckets are dealt by ranges to tasks and stored, the totals of the
    ranges (one number each) tell which range holds the rank, and the running total goes over
    that range alone.
    """
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(counts.repartitionByRange(ranges, "bucket").withColumn("range", F.spark_partition_id()))
    before = 0
    for row in dealt.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect():  # one per range
        if before + row["n"] > rank:
            break
        before += row["n"]
    running = F.sum("n").over(Window.partitionBy("range").orderBy("bucket")) - F.col("n") + before
    inside = dealt.where(F.col("range") == row["range"]).withColumn("before", running)
    found = inside.where((F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))).first().asDict()
    release(dealt)
    return found


def _order_steps(df: DataFrame) -> list[tuple[Column, bool]]:
    """``row_ord`` as a sequence of buckets, coarse to fine, and whether their number is bounded."""
    kind = df.schema[S.ROW_ORD].dataType
    parts = [F.col(f"{S.ROW_ORD}.{f.name}") for f in kind] if isinstance(kind, T.StructType) else [F.col(S.ROW_ORD)]
    kinds = [f.dataType for f in kind] if isinstance(kind, T.StructType) else [kind]
    steps = []
    for part, of in zip(parts, kinds):
        whole = isinstance(of, T.IntegralType)
        steps += [(F.shiftright(part.cast("long"), bits), True) for bits in (40, 20)] * whole + [(part, whole)]
    return steps


def _row_at(df: DataFrame, rank: int):
    """``row_ord`` of the row at 0-based ``rank`` of its order; equal ones are one row here."""
    for step, bounded in _order_steps(df):
        found = (_bucket_at if bounded else _far_bucket_at)(df, step, rank)
        df, rank = df.where(step == F.lit(found["bucket"])), rank - found["before"]
    return df.select(F.min(S.ROW_ORD)).first()[0], rank


def _literal(value) -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in value.asDict().items()]) if isinstance(value, Row) else F.lit(value)


def _is_train(cut, cut_ord, time: str) -> Column:
    before = F.col(time) < ntz(cut)
    if cut_ord is None:
        return before
    return before | ((F.col(time) == ntz(cut)) & (F.col(S.ROW_ORD) < _literal(cut_ord)))


def chronological_split(df: DataFrame, test_fraction: float = 0.2, time: str = S.TIME) -> Split:
    """The last ``test_fraction`` of the rows in time order as test, everything before as train.

    The first ``floor(n * (1 - test_fraction))`` rows by (time, ``row_ord``) are the train part.
    The cut is found by narrowing (day, second, timestamp, then ``row_ord`` where rows share
    that timestamp), each step an aggregate over bounded buckets that reads only the chosen
    bucket; rows are never sorted. Both parts are then plain filters with literals, which
    Parquet scans can use. Without ``row_ord`` all rows of the cut timestamp are test rows.
    """
    if not 0.05 <= test_fraction <= 0.5:
        raise ValueError("test_fraction must lie between 0.05 and 0.5")
    ts = F.col(time)
    ordered = S.ROW_ORD in df.columns
    times = df.select(time, *[S.ROW_ORD] * ordered)
    day = _bucket_at(times, ts.cast("date"), lambda n: F.floor(n * F.lit(1 - test_fraction)))
    if day is None:
        raise ValueError("Too few rows to train and test a model.")
    cut_rank, total = day["rank"], day["total"]
    start = F.lit(day["bucket"]).cast("timestamp_ntz")
    in_day = times.where((ts >= start) & (ts < start + F.expr("INTERVAL 1 DAY")))
    second_of_day = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    second = _bucket_at(in_day, second_of_day, cut_rank - day["before"])
    begin = start + F.make_dt_interval(secs=F.lit(second["bucket"]))
    in_second = in_day.where((ts >= begin) & (ts < begin + F.expr("INTERVAL 1 SECOND")))
    exact = _bucket_at(in_second, ts, cut_rank - day["before"] - second["before"])
    cut, cut_ord = exact["bucket"], None
    train_rows = day["before"] + second["before"] + exact["before"]
    inside = cut_rank - train_rows  # train rows that share the cut timestamp
    if exact["n"] == total:
        raise ValueError("All rows have one time: there is no earlier part to train on.")
    if ordered and inside:
        cut_ord, left = _row_at(in_second.where(ts == ntz(cut)), inside)
        train_rows = cut_rank - left
    if train_rows < 100 or total - train_rows < 20:
        raise ValueError("Too few rows to train and test a model.")
    train = _is_train(cut, cut_ord, time)
    return Split(
        train=df.where(train), test=df.where(~train), cut=cut, cut_ord=cut_ord, rows=total, train_rows=train_rows,
    )


def label_split(df: DataFrame, split: Split, time: str = S.TIME) -> DataFrame:
    """All rows with the part they belong to."""
    part = F.when(_is_train(split.cut, split.cut_ord, time), "train").otherwise("test")
    return df.withColumn("part", part)


def split_facts(labelled: DataFrame, time: str = S.TIME) -> DataFrame:
    """First and last timestamp and rows of both parts."""
    return labelled.groupBy("part").agg(
        F.min(time).alias("first_ts"), F.max(time).alias("last_ts"), F.count(F.lit(1)).alias("rows")
    )


# --- preparation -----------------------------------------------------------------------------


def impute_values(train: DataFrame, *, distributed=True) -> DataFrame:
    """One row: most frequent value per categorical column (smallest on ties), exact median
    per numeric column. Learned from the rows given, so pass the training part only."""
    if distributed:
        medians = column_quantiles(train, NUMERIC, [0.5]).select("column", F.col("q")[0].alias("median"))
    else:
        wide = train.agg(*[F.percentile(F.col(c).cast("double"), F.lit(0.5)).alias(c) for c in NUMERIC])
        medians = wide.unpivot([], NUMERIC, "column", "median")
    wide = medians.agg(*[
        F.coalesce(F.max(F.when(F.col("column") == c, F.col("median"))), F.lit(0.0)).alias(c)
        for c in NUMERIC
    ])
    return with_row(modes(train, CATEGORICAL), wide)


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the most frequent value of each column, the smallest on ties, null without values.

    One read counts the combinations of all columns; only these counts are turned into rows per
    column and added up, both times combined on the map side and spilled where there are many, so
    neither a column of all-distinct values nor one hot value is held by a task.
    """
    cells = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    typed = [F.lit(None).cast(df.schema[c].dataType) for c in columns]
    entries = [
        F.struct(F.lit(i).alias("i"), *[(F.col(c) if j == i else typed[j]).alias(f"c{j}") for j, c in enumerate(columns)])
        for i in range(len(columns))
    ]
    long = cells.select("__n", F.inline(F.array(*entries)))
    names = [f"c{j}" for j in range(len(columns))]
    counts = long.groupBy("i", *names).agg(F.sum("__n").alias("n"))
    best = [
        F.min(F.when((F.col("i") == j) & F.col(c).isNotNull(), F.struct((-F.col("n")).alias("n"), F.col(c).alias("v"))))["v"].alias(columns[j])
        for j, c in enumerate(names)
    ]
    return counts.agg(*best)


def scale_values(train: DataFrame, fills: dict) -> DataFrame:
    """One row: mean and population deviation per numeric column after imputation."""
    filled = {c: F.coalesce(F.col(c), F.lit(float(fills[c]))) for c in NUMERIC}
    return train.agg(
        *[F.avg(v).alias(f"mean_{c}") for c, v in filled.items()],
        *[F.when(F.min(v) == F.max(v), F.lit(1.0)).otherwise(F.stddev_pop(v)).alias(f"std_{c}")
          for c, v in filled.items()],
    )


def _quoted(value) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def fit_preparation(train: DataFrame) -> PipelineModel:
    """Impute, one-hot encode and standardise, fitted on the training rows only.

    Learned constants sit in a SQL stage, so the fitted pipeline saves and loads as a whole.
    A category unseen in training encodes as all zeros.
    """
    fills = impute_values(train).first().asDict()
    scales = scale_values(train, fills).first().asDict()
    parts = [
        f"coalesce(CAST({c} AS STRING), {_quoted(fills[c])}) AS {c}_text" for c in CATEGORICAL
    ] + [
        f"(coalesce({c}, {float(fills[c])!r}D) - {scales[f'mean_{c}']!r}D)"
        f" / {scales[f'std_{c}']!r}D AS {c}_scaled"
        for c in NUMERIC
    ]
    fill = SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")
    filled = fill.transform(train)
    index = StringIndexer(
        inputCols=[f"{c}_text" for c in CATEGORICAL],
        outputCols=[f"{c}_index" for c in CATEGORICAL],
        handleInvalid="keep", stringOrderType="alphabetAsc",
    ).fit(filled)
    encode = OneHotEncoder(
        inputCols=[f"{c}_index" for c in CATEGORICAL],
        outputCols=[f"{c}_onehot" for c in CATEGORICAL],
    ).fit(index.transform(filled))
    assemble = VectorAssembler(
        inputCols=[f"{c}_onehot" for c in CATEGORICAL] + [f"{c}_scaled" for c in NUMERIC] + BINARY,
        outputCol="features",
    )
    return PipelineModel(stages=[fill, index, encode, assemble])


def feature_names(preparation: PipelineModel) -> list[str]:
    """Name of every slot of the feature vector, ``<column>_<category>`` for one-hot slots."""
    index = next(s for s in preparation.stages if isinstance(s, StringIndexerModel))
    one_hot = [f"{c}_{v}" for c, labels in zip(CATEGORICAL, index.labelsArray) for v in labels]
    return one_hot + NUMERIC + BINARY


# --- models ----------------------------------------------------------------------------------

#: Depth limit of the forest's trees, the same for every size of input. Spark allows up to 30;
#: with 100 trees a depth of 12 means at most 800,000 nodes, which live on the driver.
MAX_DEPTH = 12


def linear_regression(prediction: str = MODELS[LINEAR]) -> LinearRegression:
    return LinearRegression(
        featuresCol="features", labelCol=S.TARGET, predictionCol=prediction, regParam=0.0
    )


def random_forest(
    trees: int = 100, leaf: int = 3, seed: int = 42, prediction: str = MODELS[FOREST],
    task_memory: int = 2048, max_depth: int = MAX_DEPTH,
) -> RandomForestRegressor:
    """``task_memory`` (MB) bounds the node statistics a task builds at a time, a quarter of it.
    Less memory means more passes, not another result. The driver holds up to
    ``trees * 2 ** (max_depth + 1)`` nodes; it is the caller who sets both."""
    return RandomForestRegressor(
        featuresCol="features", labelCol=S.TARGET, predictionCol=prediction, numTrees=trees,
        minInstancesPerNode=leaf, maxDepth=max_depth,
        featureSubsetStrategy="all", seed=seed,
        # Deep trees: keep each row's node instead of shipping the growing forest every level.
        cacheNodeIds=True, checkpointInterval=10, maxMemoryInMB=max(8, min(2048, task_memory // 4)),
    )


def baseline_predictions(train: DataFrame, test: DataFrame) -> DataFrame:
    """The training mean as the prediction of every test row."""
    mean = train.agg(F.avg(S.TARGET).alias("m")).scalar()
    return test.withColumn(MODELS[BASELINE], F.greatest(mean, F.lit(0.0)))


def clip(prediction: str) -> Column:
    """A volume cannot be negative."""
    return F.greatest(F.col(prediction), F.lit(0.0))


def metrics(scored: DataFrame, models: dict[str, str] | None = None) -> DataFrame:
    """MAE, RMSE and R2 of every prediction column in one pass (rows: model, MAE, RMSE, R2)."""
    models = models or {m: c for m, c in MODELS.items() if c in scored.columns}
    y = F.col(S.TARGET)
    sst = F.var_pop(y) * F.count(y)
    aggregates = []
    for i, prediction in enumerate(models.values()):
        error = y - F.col(prediction)
        aggregates += [
            F.avg(F.abs(error)).alias(f"mae{i}"), F.avg(error * error).alias(f"mse{i}"),
            F.sum(error * error).alias(f"sse{i}"),
        ]
    wide = scored.agg(sst.alias("sst"), *aggregates)
    return wide.select(F.inline(F.array(*[
        F.struct(
            F.lit(model).alias("model"), F.col(f"mae{i}").alias("MAE"),
            F.sqrt(f"mse{i}").alias("RMSE"),
            (F.lit(1.0) - F.col(f"sse{i}") / F.nullif("sst", F.lit(0.0))).alias("R2"),
        )
        for i, model in enumerate(models)
    ])))


def metrics_long(table: DataFrame) -> DataFrame:
    """The metric table as rows (model, metric, value)."""
    return table.unpivot(["model"], ["MAE", "RMSE", "R2"], "metric", "value")


def best_model(table: DataFrame) -> DataFrame:
    """The real model with the lowest RMSE, beside the baseline it has to beat."""
    real = F.col("model") != BASELINE
    return table.agg(
        F.min_by("model", F.when(real, F.struct("RMSE", "model"))).alias("best_model"),
        F.min(F.when(real, F.col("RMSE"))).alias("best_rmse"),
        F.max(F.when(~real, F.col("RMSE"))).alias("baseline_rmse"),
    )


def shown_metrics(table: DataFrame, digits: int = 3) -> DataFrame:
    return table.select("model", *[round_to(c, digits).alias(c) for c in ("MAE", "RMSE", "R2")])


# Conditions assumed where a table to score does not give them.
DEFAULT_CONDITIONS = {
    "weather_main": "Clear", "temp_c": 10.0, "rain_1h": 0.0, "snow_1h": 0.0, "clouds_all": 40.0,
    "is_holiday": 0,
}


def score(model: PipelineModel, conditions: DataFrame, prediction: str) -> DataFrame:
    """Predict a table of conditions.

    Hour, weekday and month are needed; other columns the table lacks take their default. The
    weekend flag follows from the weekday.
    """
    S.require_columns(conditions, ["hour", "day_of_week", "month"], "table of conditions")
    absent = {c: F.lit(v) for c, v in DEFAULT_CONDITIONS.items() if c not in conditions.columns}
    full = conditions.withColumns(
        {**absent, "is_weekend": (F.col("day_of_week") >= 5).cast("int")}
    )
    out = model.transform(full).withColumn("predicted", clip(prediction))
    return out.select(*full.columns, "predicted")


def feature_importance(spark, model, names: list[str], n: int = 15) -> DataFrame | None:
    """The ``n`` most important features of a forest; None for models without importances.

    Only ``len(names)`` numbers are involved, and they already live on the driver.
    """
    if not isinstance(model, RandomForestRegressionModel):
        return None
    values = model.featureImportances.toArray()
    rows = sorted(zip(names, map(float, values)), key=lambda r: (-r[1], r[0]))[:n]
    return spark.createDataFrame(rows, "feature string, importance double")


# --- views -----------------------------------------------------------------------------------


def window_view(scored: DataFrame, prediction: str, start: str, days: int = 7) -> DataFrame:
    """Actual and predicted values in ``[start, start + days)``, one to thirty days."""
    if not 1 <= days <= 30:
        raise ValueError("a window covers 1 to 30 days")
    ts = F.col(S.TIME)
    first = F.lit(start).cast("date")
    return scored.where(
        (ts >= first.cast("timestamp_ntz"))
        & (ts < F.date_add(first, days).cast("timestamp_ntz"))
    ).select(S.TIME, F.col(S.TARGET).alias("actual"), F.col(prediction).alias("predicted"))


def residual_sample(
    scored: DataFrame, prediction: str, n: int = 3_000, seed: int = 0, key: str = S.ROW_ORD
) -> DataFrame:
    """A bounded sample of actual and predicted values with the common axis maximum."""
    sample = bounded_sample(
        scored.select(key, S.TIME, F.col(S.TARGET).alias("actual"), F.col(prediction).alias("predicted")),
        n, key, seed,
    )
    top = F.greatest(F.max("actual").over(Window.partitionBy()), F.max("predicted").over(Window.partitionBy()))
    return sample.withColumn("axis_max", top)
