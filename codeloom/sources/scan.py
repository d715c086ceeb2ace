"""Scanning a source tree into files with texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.keys import short_sha
from codeloom.operators.files import MAX_FILE_SIZE, is_config, is_entrypoint, is_test, language, skip_reason
from codeloom.shipping import ship


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of all files under root, paths relative to it. The driver lists the first level; what is below each of its folders is listed by tasks. Spark's own readers would leave out names that begin with a dot or underscore, and files of no bytes."""
    fs, base = _open(root)
    top = [(i.base_name, i.size if i.is_file else None) for i in fs.get_file_info(pafs.FileSelector(base, recursive=False))]

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _open(root)
        for pdf in batches:
            for name in pdf["path"]:
                found = fs.get_file_info(pafs.FileSelector(f"{base.rstrip('/')}/{name}", recursive=True))
                yield pd.DataFrame([(i.path[len(base.rstrip("/")) + 1 :], i.size) for i in found if i.is_file], columns=["path", "size"])

    first = spark.createDataFrame(top, "path string, size long")
    folders = first.where("size is null").repartition(max(1, min(len(top), 4 * spark.sparkContext.defaultParallelism)), "path")
    return first.where("size is not null").unionByName(folders.mapInPandas(below, "path string, size long"))


def _read(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        for b in batches:
            for path, wanted, k in zip(b.column("path").to_pylist(), b.column("wanted").to_pylist(), range(b.num_rows)):
                raw = None
                if wanted:
                    with fs.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                        raw = f.read()
                one = b.slice(k, 1)  # a file is a batch, as files may be large
                yield pa.RecordBatch.from_arrays([one.column("path"), one.column("size"), one.column("ord"), pa.array([raw], pa.binary())], names=["path", "size", "ord", "content"])

    return run


def scan_repository(spark: SparkSession, root: str, repo: str, patterns: list[str] | None = None, max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """(file_id, repo, path, size, hash, language, flags, content, skip_reason, ord) of the files under root, in the order of their paths (ord).

    Skipped files keep their reason and have no text; those skipped by path or size are not read and have no hash. The hash is that of the raw bytes; texts are read as UTF-8 with replacement characters for
    malformed bytes and \\n as line end. An empty folder gives no rows.
    """
    ship(spark)
    ordered = listing(spark, root).orderBy("path").withColumn("ord", F.monotonically_increasing_id())
    by_path = skip_reason(F.col("path"), F.col("size"), F.lit(False), patterns, max_size)
    rows = ordered.withColumn("wanted", by_path.isNull()).mapInArrow(_read(root), "path string, size long, ord long, content binary")
    nul = F.contains(F.substring("content", 1, 8192), F.lit(b"\x00"))
    reason = skip_reason(F.col("path"), F.col("size"), F.coalesce(nul, F.lit(False)), patterns, max_size)
    lang = language(F.col("path"))
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n")
    digest = F.sha2("content", 256)
    return rows.select(
        short_sha(16, F.lit(repo), F.col("path"), digest).alias("file_id"), F.lit(repo).alias("repo"), "path", "size", digest.alias("hash"), lang.alias("language"), is_entrypoint(F.col("path"), lang).alias("is_entrypoint"),
        is_test(F.col("path")).alias("is_test"), is_config(F.col("path")).alias("is_config"), F.when(reason.isNull(), text).alias("content"), reason.alias("skip_reason"), "ord",
    )
