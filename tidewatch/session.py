"""Session settings the operators are written for, and lineage cutting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidewatch", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution (partition coalescing, skewed-join splitting) and UTC.

    Shuffle partitions are left to the cluster's setting; with adaptive execution a generous
    number is right at scale and is coalesced for small inputs.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Where a local session names none, a folder in its warehouse; elsewhere that is an error. It
    is also made the session's checkpoint folder, for the fits that cut their own lineage.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and return that table.

    For tables that iterative fits read many times. A lost executor then costs a re-read of its
    part, not a re-run of everything upstream; and unlike a row checkpoint the table is
    compressed, pruned by column, and has a size the optimizer knows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewatch/{spark.sparkContext.applicationId}/{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def release(df: DataFrame) -> None:
    """Delete a table made by :func:`cut_lineage` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        if "/tidewatch/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_UNITS = {"k": 1 / 1024, "m": 1, "g": 1024, "t": 1024 * 1024}


def memory_per_task(spark: SparkSession) -> int:
    """Heap megabytes one concurrent task can count on, from the session's settings."""
    context = spark.sparkContext
    local = context.master.startswith("local")
    conf = context.getConf()
    text = conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g").lower().rstrip("b")
    heap = float(text[:-1]) * _UNITS[text[-1]] if text[-1] in _UNITS else float(text) / 2**20
    tasks = context.defaultParallelism if local else int(conf.get("spark.executor.cores", "1"))
    return max(1, int(heap / tasks))


#: Partitions of the rows that iterative fits read, unless the caller names another number.
FIT_PARTITIONS = 32


def spread(df: DataFrame, key: str, partitions: int = FIT_PARTITIONS) -> DataFrame:
    """The rows dealt by ``key`` to a number of partitions that does not depend on the cluster.

    Fits that draw random numbers per partition then give the same model everywhere. Choose
    more partitions for more rows; the number is part of what defines the result.
    """
    return df.repartition(partitions, key)
