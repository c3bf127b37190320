"""Reading raw observation files and stored clean tables."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions.scalars import blank_missing
from tidewatch.sources import records


def read_raw_csv(
    spark: SparkSession, path: str, *, multiline: bool = True, parallel: bool = True, partitions: int | None = None,
    verify: bool = True,
) -> DataFrame:
    """CSV or gzip CSV with a header, every column as text, plus ``row_ord``.

    Columns are taken by header name (a user schema would be applied by position). Texts that
    stand for a missing value become null. ``row_ord`` is the position of the record: file,
    block within the file, then order within the block; it is fixed on the scan and must not be
    rebuilt after a shuffle. Gzip cannot be split, so such files arrive one task each; give
    ``partitions`` to spread them before heavy work.

    A quoted text may hold line breaks. Such files are read in parallel blocks all the same
    (see :mod:`tidewatch.sources.records`), after one pass that counts quotes. Their quoting must
    be regular: a quote inside a field that does not begin with one is an error that says so, and
    ``parallel=False`` then reads each file in one task as its parser sees fit. Files known to have
    no line breaks in texts are read without that pass by ``multiline=False``. Compressed files
    are read through once to see that they are whole (``verify=False`` trusts them, where quotes
    need not be counted), so damage anywhere in a file is an error that names it.
    """
    options = {"header": True, "inferSchema": False, "escape": '"', "enforceSchema": False}  # headers must agree
    try:
        df = spark.read.options(**options, multiLine=multiline).csv(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise _source_missing(path) from error
        raise ValueError(f"'{path}' cannot be read as CSV: {error}") from error
    except (Py4JJavaError, PySparkException) as error:
        raise ValueError(f"'{path}' cannot be read as CSV.") from error
    S.require_columns(df, S.REQUIRED_COLUMNS, f"file '{path}'")
    files = df.inputFiles()
    packed = [name for name in files if name.endswith(".gz")]
    if multiline and parallel and files:
        try:
            df = records.quoted_records(spark, path, df.columns, options["escape"])
        except (Py4JJavaError, PySparkException) as error:
            reason = "a compressed file is damaged." if packed else str(error)
            raise ValueError(f"'{path}' cannot be read as CSV: {reason}") from error
        place = F.struct("__file", "__block", "__line")
    else:
        if verify and packed:
            try:
                spark.read.text(packed).agg(F.count(F.lit(1))).collect()
            except (Py4JJavaError, PySparkException) as error:
                raise ValueError(f"'{path}' cannot be read as CSV: a compressed file is damaged.") from error
        place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    names = [c for c in df.columns if not c.startswith("__")] if "__file" in df.columns else df.columns
    df = df.select(
        *[blank_missing(F.col(f"`{c}`")).alias(c) for c in names],
        place.cast("struct<file:string,block:bigint,line:bigint>").alias(S.ROW_ORD),
    )
    return df.repartition(partitions) if partitions else df


def _source_missing(path: str) -> S.SourceNotFoundError:
    return S.SourceNotFoundError(
        f"Nothing to read at '{path}'. Download the raw observation file (.csv or .csv.gz) and "
        "pass its path, or a folder or glob of such files."
    )


def with_row_ord(df: DataFrame) -> DataFrame:
    """``row_ord`` for a table read straight from Parquet: file path and row index."""
    return df.withColumn(
        S.ROW_ORD,
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("line"),
        ),
    )


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """A clean table stored by :func:`tidewatch.sources.writers.write_clean`."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise _source_missing(path) from error
        raise


def preview(raw: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` records in input order."""
    return raw.orderBy(S.ROW_ORD).limit(n)
