"""The folder that driver and executors share, and files in it written and read by tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; the warehouse folder where a local one has none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_root(spark)}/corpus/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


#: Whether a statement's shuffle files go when it ends. Otherwise they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    What was shuffled to make it is deleted when it is written.
    """
    spark = df.sparkSession
    path, before = new_folder(spark, what), spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` marked not to go to every task in a join, however small Spark takes it to be.

    Spark sizes a table by its compressed files and by the width of rows, so it takes one made by an explode, or of
    values that repeat, for many times smaller than it is.
    """
    return df.hint("merge")


def file_system(path: str):
    """The pyarrow file system of ``path`` (a URI or a plain local path) and the path within it."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system, inner


def as_uri(path: str) -> str:
    """``file:/x`` as the ``file:///x`` that pyarrow reads; other paths as they are."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/corpus/" in file:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns of a row, to find it again: equal rows have equal hashes."""
    return F.xxhash64(*(F.coalesce(df[c].cast("string"), F.lit("\0")) for c in df.columns))
