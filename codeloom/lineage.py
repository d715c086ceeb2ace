"""Cutting the lineage of iterative plans in storage that every executor shares."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or the one set on the context. On one machine (tests) a temporary one; anywhere else there must be one, as executors could not share it."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _roots:
        _roots[sc.applicationId] = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    return _roots[sc.applicationId]


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, so that a lost executor costs no rerun of earlier rounds, and later plans know its size.

    Only the columns a later step needs are read again. Tables stay until clear() or the cluster removes them.
    """
    path = f"{_tables(df.sparkSession)}/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes the tables that this application has written, once its results are stored; frames that come from them can be read no more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
