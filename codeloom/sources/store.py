"""Snapshots of knowledge as partitioned parquet tables, with JSON in and out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Tables <root>/tables/<name>, partitioned by repo_id and snapshot_id, and a row in <root>/manifest for each snapshot that is complete.

    A snapshot counts once its manifest row is written, which happens last; so readers never see half of one, and a write that an executor loss breaks off can be repeated.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/tables/{name}"

    def write(self, repo_id: str, snapshot_id: str, tables: dict[str, DataFrame], day: str) -> None:
        for name, df in tables.items():
            keyed = df.withColumns({"repo_id": F.lit(repo_id), "snapshot_id": F.lit(snapshot_id)})
            keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id", "snapshot_id").parquet(self._path(name))
        row = [(repo_id, snapshot_id, day, sorted(tables), False)]
        self.spark.createDataFrame(row, "repo_id string, snapshot_id string, day string, tables array<string>, deleted boolean").withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/manifest")

    def manifest(self) -> DataFrame:
        """The latest row of each snapshot that is not deleted, the newest first."""
        m = self.spark.read.parquet(f"{self.root}/manifest")
        last = m.groupBy("repo_id", "snapshot_id").agg(F.max(F.struct("at", "day", "tables", "deleted")).alias("m")).select("repo_id", "snapshot_id", "m.*")
        return last.where("not deleted").drop("deleted").orderBy(F.desc("at"))

    def latest(self, repo_id: str, day: str | None = None) -> str | None:
        m = self.manifest().where(F.col("repo_id") == repo_id)
        row = (m.where(F.col("day") == day) if day else m).first()
        return row["snapshot_id"] if row else None

    def read(self, name: str, repo_id: str, snapshot_id: str | None = None) -> DataFrame | None:
        """A table of a snapshot (the latest where none is named); None where there is no such snapshot."""
        snapshot_id = snapshot_id or self.latest(repo_id)
        known = self.manifest().where((F.col("repo_id") == repo_id) & (F.col("snapshot_id") == snapshot_id)).first() if snapshot_id else None
        if not known or name not in known["tables"]:
            return None
        return self.spark.read.parquet(self._path(name)).where((F.col("repo_id") == repo_id) & (F.col("snapshot_id") == snapshot_id))

    def delete(self, repo_id: str, snapshot_id: str) -> bool:
        """Marks a snapshot as deleted; whether there was one."""
        m = self.manifest().where((F.col("repo_id") == repo_id) & (F.col("snapshot_id") == snapshot_id))
        if not m.count():
            return False
        m.withColumn("deleted", F.lit(True)).withColumn("at", F.current_timestamp()).select("repo_id", "snapshot_id", "day", "tables", "deleted", "at").write.mode("append").parquet(f"{self.root}/manifest")
        return True

    def export_json(self, repo_id: str, snapshot_id: str, folder: str) -> None:
        """One folder of JSON lines a table, nulls kept, written by the executors."""
        row = self.manifest().where((F.col("repo_id") == repo_id) & (F.col("snapshot_id") == snapshot_id)).first()
        if row is None:
            raise KeyError(f"no snapshot {snapshot_id} of {repo_id}")
        for name in row["tables"]:
            self.read(name, repo_id, snapshot_id).write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/{name}")

    def metadata(self, repo_id: str) -> str:
        """A small JSON text about the latest snapshot: names and row counts."""
        snap = self.latest(repo_id)
        row = self.manifest().where((F.col("repo_id") == repo_id) & (F.col("snapshot_id") == snap)).first() if snap else None
        names = row["tables"] if row else []
        return json.dumps({"repo_id": repo_id, "snapshot_id": snap, "counts": {n: self.read(n, repo_id, snap).count() for n in names}}, indent=2, sort_keys=True)


def save_index(tf: DataFrame, idf: DataFrame, norms: DataFrame, folder: str) -> None:
    """A search index; postings are clustered by term, so that a query's terms prune row groups."""
    tf.repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{folder}/postings")
    idf.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/idf")
    norms.write.mode("overwrite").parquet(f"{folder}/norms")


def load_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{folder}/{n}") for n in ("postings", "idf", "norms"))
