"""Spark sessions for tests, benches and the command line."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8, app: str = "codeloom") -> SparkSession:
    """A local session with UTC times and a shuffle width fit for one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.local.dir", os.environ.get("SPARK_LOCAL_DIRS") or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
