"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only where that is unset and all tasks run here."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="terrace-")
    return _OWN[context.applicationId]


def path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{spark.sparkContext.applicationId}-core-{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table: whatever reads it reads the same rows in the same ranges."""
    at = path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def clear(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application; results not yet read can't be read any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/{spark.sparkContext.applicationId}-core-*")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.globStatus(where) or []:
        files.delete(status.getPath(), True)
