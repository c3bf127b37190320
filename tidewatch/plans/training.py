"""Train, compare and store the regression models."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.operators import regression as R
from tidewatch.session import FIT_PARTITIONS, cut_lineage, memory_per_task, shared_folder, spread


@dataclass
class Training:
    results: DataFrame  # metric table, one row per model
    best_model: str
    models: dict[str, PipelineModel]  # preparation and estimator as one pipeline
    scored: DataFrame  # test rows with one prediction column per model
    split: R.Split
    names: list[str]  # feature vector slots
    metadata: dict

    def importance(self, n: int = 15) -> DataFrame:
        forest = self.models[R.FOREST].stages[-1]
        return R.feature_importance(self.scored.sparkSession, forest, self.names, n)


def fingerprint(df: DataFrame) -> str:
    """Order-independent fingerprint of all columns: number of rows and sum of row hashes."""
    hashes = F.sum(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(df.columns)]).cast("decimal(38,0)"))
    row = df.agg(F.count(F.lit(1)).alias("n"), hashes.alias("h")).first()
    return f"{row['n']}-{row['h'] or 0}"


def train_and_evaluate(
    df: DataFrame, test_fraction: float = 0.2, save_to: str | None = None, *, trees: int = 100,
    seed: int = 42, stored: bool = False, max_depth: int = R.MAX_DEPTH, partitions: int = FIT_PARTITIONS,
) -> Training:
    """Fit the baseline, the linear model and the forest on the earlier rows and evaluate them
    on the later ones. The real model with the lowest RMSE is the best.

    The columns in use are written to a table first, because each fit reads them many times;
    say ``stored`` when ``df`` is read straight from a table already. ``max_depth`` and
    ``partitions`` (of the training rows) are part of what defines the forest. With
    ``save_to`` the best model goes there with the data's fingerprint, by which
    :func:`is_current` tells whether it still belongs to a table.
    """
    shared_folder(df.sparkSession)  # the forest cuts its lineage there
    S.require_columns(df, [*R.FEATURES, S.TARGET, S.TIME], "clean table")
    keep = [c for c in [S.ROW_ORD, S.TIME, S.TARGET, *R.FEATURES] if c in df.columns]
    base = df.select(*keep) if stored else cut_lineage(df.select(*keep))
    split = R.chronological_split(base, test_fraction)
    train, test = spread(split.train, S.TIME, partitions).persist(), split.test

    preparation = R.fit_preparation(train)
    prepared = preparation.transform(train).select("features", F.col(S.TARGET).cast("double")).persist()
    linear = R.linear_regression().fit(prepared)
    forest = R.random_forest(
        trees=trees, seed=seed, task_memory=memory_per_task(df.sparkSession), max_depth=max_depth
    ).fit(prepared)
    prepared.unpersist()

    # Test rows are the last in time, so they lie in few files: dealt anew, as each meets every tree.
    scored = preparation.transform(R.baseline_predictions(train, test.repartition(partitions)))
    for model in (linear, forest):
        name = model.getPredictionCol()
        scored = model.transform(scored).withColumn(name, R.clip(name))
    scored = scored.select(*keep, *R.MODELS.values()).persist()

    results = R.metrics(scored)
    rows = {r["model"]: r.asDict() for r in results.collect()}  # three rows
    best = min((m for m in rows if m != R.BASELINE), key=lambda m: rows[m]["RMSE"])
    models = {
        R.LINEAR: PipelineModel(stages=[*preparation.stages, linear]),
        R.FOREST: PipelineModel(stages=[*preparation.stages, forest]),
    }
    periods = {
        r["part"]: (str(r["first_ts"]), str(r["last_ts"]))
        for r in R.split_facts(R.label_split(base, split)).collect()  # two rows
    }
    metadata = {
        "model_name": best,
        "prediction": R.MODELS[best],
        "feature_columns": R.FEATURES,
        "metrics": {k: float(rows[best][k]) for k in ("MAE", "RMSE", "R2")},
        "train_period": list(periods["train"]),
        "test_period": list(periods["test"]),
        "rows": split.rows,
        "fingerprint": fingerprint(base),
        "settings": f"{test_fraction} {trees} {seed} {max_depth} {partitions}",
        "trained_at": datetime.now(timezone.utc).isoformat(timespec="seconds"),
    }
    if save_to:
        save_model(df.sparkSession, save_to, models[best], metadata)
    train.unpersist()
    return Training(results, best, models, scored, split, R.feature_names(preparation), metadata)


def save_model(spark: SparkSession, path: str, model: PipelineModel, metadata: dict) -> None:
    """The fitted pipeline under ``path/model`` and its one-row description beside it."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([Row(**metadata)]).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/metadata"
    )


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict] | None:
    """What :func:`save_model` stored, or None where nothing is stored."""
    try:
        metadata = spark.read.parquet(f"{path}/metadata").first().asDict(recursive=True)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return PipelineModel.load(f"{path}/model"), metadata


def is_current(metadata: dict, df: DataFrame) -> bool:
    """Whether a stored model was fitted on these very rows."""
    keep = [c for c in [S.ROW_ORD, S.TIME, S.TARGET, *R.FEATURES] if c in df.columns]
    return metadata["fingerprint"] == fingerprint(df.select(*keep))
