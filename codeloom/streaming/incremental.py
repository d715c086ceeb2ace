"""Incremental ingest (an extension): new file rows arrive as a stream, and each content is taken once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.keys import norm_id, norm_path


def file_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream over parquet files that are dropped into a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def new_contents(files: DataFrame, delay: str = "7 days") -> DataFrame:
    """The first row of each (path, hash) within the delay. State is keyed by content, so a replay changes nothing, and the watermark bounds it."""
    keyed = files.select(norm_path("path").alias("path"), norm_id("hash").alias("hash"), "size", "ingested_at").where("path is not null and hash is not null")
    return keyed.withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["path", "hash"])


def deliveries(files: DataFrame, width: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Rows and bytes that arrived per window and snapshot."""
    w = files.withWatermark("ingested_at", delay).groupBy(F.window("ingested_at", width), norm_id("snapshot_id").alias("snapshot_id"))
    return w.agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes")).select(F.col("window.start").alias("start"), "snapshot_id", "n_rows", "n_bytes")


def run_once(df: DataFrame, target: str, checkpoint: str, mode: str = "append"):
    """Runs a stream over all that is there and stops; the file sink and its checkpoint make every row arrive exactly once."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
