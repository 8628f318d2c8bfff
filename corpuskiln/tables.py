"""Reading the input tables and writing intermediate ones."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table as read from files, over all cores if the files make fewer tasks than these (one small file is one task)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_if_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet files of a folder on any file system; no rows where it does not exist."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a path or URL as the cluster knows it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the one that all executors share; deleted when the program ends.

    A cluster names the shared folder in ``spark.checkpoint.dir``; only where that is unset (tests, one machine) a
    temporary one takes its place.
    """
    application = spark.sparkContext.applicationId
    if application not in _own:
        shared = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="corpuskiln-")
        _own[application] = f"{shared.rstrip('/')}/corpuskiln-{application}"
        atexit.register(_drop_quietly, spark)
    return _own[application]


def drop_written(spark: SparkSession) -> None:
    """Deletes all that ``written`` wrote; what reads it is of no use afterwards. Best called before the session stops: later
    the shared folder keeps its files."""
    if spark.sparkContext._jsc is None or spark.sparkContext.applicationId not in _own:
        return
    files, path = hadoop_path(spark, _own.pop(spark.sparkContext.applicationId))
    files.delete(path, True)


def _drop_quietly(spark: SparkSession) -> None:
    try:
        drop_written(spark)
    except Exception:  # no reason to fail at the end of the program
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
