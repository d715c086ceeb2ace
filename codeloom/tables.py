"""The given tables, one parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.keys import extension, norm_id, norm_path
from codeloom.shipping import ship

#: Extensions of source files and their languages.
SOURCE_LANGUAGES = {"py": "python", "ts": "typescript", "js": "javascript", "cs": "c_sharp"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def file_paths(files: DataFrame) -> DataFrame:
    """One row (fid, path) per file id; of several rows the smallest path counts. Rows without id or path refer to nothing."""
    return (
        files.select(norm_id("file_id").alias("fid"), norm_path("path").alias("path"))
        .where("fid is not null and path is not null")
        .groupBy("fid")
        .agg(F.min("path").alias("path"))
    )


def with_paths(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Documents with the path of their file and its extension (ext); documents without a known file keep nulls.

    The join moves the texts by the key of their file, so it is made with the keys alone and the texts follow doc_id only when Spark broadcasts neither.
    """
    keyed = documents.withColumn("fid", norm_id("file_id"))
    return keyed.join(file_paths(files), "fid", "left").withColumn("ext", extension(F.col("path")))


def source_documents(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Documents whose file's path ends in .py, .ts, .js or .cs, with path, ext and code_language."""
    langs = F.create_map(*[F.lit(x) for kv in SOURCE_LANGUAGES.items() for x in kv])
    paths = file_paths(files).withColumn("ext", extension(F.col("path"))).where(F.col("ext").isin(*SOURCE_LANGUAGES))
    keyed = documents.where("text is not null").withColumn("fid", norm_id("file_id"))
    return keyed.join(paths, "fid").withColumn("code_language", langs[F.col("ext")])


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than the cluster has cores is dealt out over all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
