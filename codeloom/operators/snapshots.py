"""What changed between full snapshots (problem 5).

Record keys get persistent ordinals, dense within (branch, record type, bucket of the key's hash). Each snapshot becomes, per bucket, a bitmap
of its ordinals (cut after its last byte in use) and a vector of content hashes aligned to the bitmap's set bits. Consecutive snapshots meet
bucket by bucket: AND-NOT of the bitmaps gives additions and removals, AND gives the common keys, whose aligned vectors expose changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.keys import norm_id, norm_path
from codeloom.lineage import cut

#: Keys of a branch and record type are spread over buckets of about this many; a bitmap container holds 32768.
BUCKET_KEYS = 16384


def complete_snapshots(snapshots: DataFrame) -> DataFrame:
    """(branch_key, snap, prev): the complete snapshots with the complete one before on the same repository and branch, by the instant of created_at.

    Repeated rows count once; snapshots without id or readable instant have no place in the order and are left out; equal instants are ordered by id.
    """
    one = (
        snapshots.where("lower(trim(status)) = 'complete'")
        .select(
            F.concat_ws("\x01", F.coalesce(norm_id("repo_id"), F.lit("")), F.coalesce(F.trim("branch"), F.lit(""))).alias("branch_key"),
            norm_id("snapshot_id").alias("snap"), F.try_to_timestamp("created_at").alias("at"),
        )
        .where("snap is not null and at is not null")
        .groupBy("snap").agg(F.min(F.struct("at", "branch_key")).alias("s")).select("snap", "s.*")
    )
    return one.withColumn("prev", F.lag("snap").over(Window.partitionBy("branch_key").orderBy("at", "snap"))).select("branch_key", "snap", "prev")


def snapshot_records(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(snap, record_type, key, h): one row per record of a snapshot. Rows without snapshot or key are no records; of conflicting rows of one record the latest counts, then the smaller hash; a null hash is a value."""
    f = files.select(norm_id("snapshot_id").alias("snap"), F.lit("file").alias("record_type"), norm_path("path").alias("key"), F.xxhash64(norm_id("hash")).alias("h"), F.col("ingested_at").alias("at"))
    s = symbols.select(norm_id("snapshot_id").alias("snap"), F.lit("symbol").alias("record_type"), norm_id("symbol_id").alias("key"), F.lit(0).cast("bigint").alias("h"), F.col("ingested_at").alias("at"))
    both = f.unionByName(s).where("snap is not null and key is not null and key <> ''")
    return both.groupBy("snap", "record_type", "key").agg(F.max_by("h", F.struct("at", -F.col("h").cast("decimal(20,0)"))).alias("h"))


def assign_ordinals(keys: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Ordinals, from 1, (branch_key, record_type, bucket, key, ordinal) for distinct keys (branch_key, record_type, key).

    known: ordinals of earlier runs; they are kept (with their buckets), and new keys follow the largest of their bucket. The number of buckets
    follows the number of keys, so no window gets more than about BUCKET_KEYS rows, however large a branch is.
    """
    n = keys.groupBy("branch_key", "record_type").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BUCKET_KEYS)).cast("bigint").alias("n_buckets"))
    if known is not None:
        old = known.groupBy("branch_key", "record_type").agg((F.max("bucket") + 1).alias("old_buckets"))
        n = n.join(old, ["branch_key", "record_type"], "left").withColumn("n_buckets", F.coalesce("old_buckets", "n_buckets")).drop("old_buckets")
        keys = keys.join(known.select("branch_key", "record_type", "key"), ["branch_key", "record_type", "key"], "left_anti")
    placed = keys.join(n, ["branch_key", "record_type"]).withColumn("bucket", F.pmod(F.xxhash64("key"), "n_buckets"))
    w = Window.partitionBy("branch_key", "record_type", "bucket").orderBy("key")
    new = placed.select("branch_key", "record_type", "bucket", "key", F.row_number().over(w).cast("bigint").alias("ordinal"))
    if known is None:
        return new
    top = known.groupBy("branch_key", "record_type", "bucket").agg(F.max("ordinal").alias("base"))
    moved = new.join(top, ["branch_key", "record_type", "bucket"], "left").withColumn("ordinal", F.col("ordinal") + F.coalesce("base", F.lit(0))).drop("base")
    return known.select(*moved.columns).unionByName(moved)


def containers(rows: DataFrame) -> DataFrame:
    """(branch_key, record_type, snap, bucket, part, bits, vec) of rows (…, bucket, ordinal, h): vec holds the hashes in the order of the set bits."""
    pos = rows.withColumn("part", F.bitmap_bucket_number("ordinal")).withColumn("pos", F.bitmap_bit_position("ordinal"))
    g = pos.groupBy("branch_key", "record_type", "snap", "bucket", "part").agg(
        F.bitmap_construct_agg("pos").alias("bits"), F.max("pos").alias("top"), F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("v")
    )
    return g.select("branch_key", "record_type", "snap", "bucket", "part", F.expr("substring(bits, 1, cast(top div 8 as int) + 1)").alias("bits"), F.col("v.h").alias("vec"))


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordinals added (1), removed (2) and changed (3) of each pair of containers; an absent one is empty."""

    def bits(raw: bytes | None, width: int) -> np.ndarray:
        own = np.unpackbits(np.frombuffer(raw or b"", np.uint8), bitorder="little")
        return np.concatenate([own, np.zeros(width - len(own), np.uint8)]).astype(bool)

    schema = pa.schema([("row", pa.int64()), ("pos", pa.int64()), ("change", pa.int32())])
    for b in batches:
        rows, poss, kinds = [], [], []
        cv, pv = b.column("cur_vec"), b.column("prev_vec")
        for i, (row, cur, prev) in enumerate(zip(b.column("row").to_pylist(), b.column("cur_bits").to_pylist(), b.column("prev_bits").to_pylist())):
            width = 8 * max(len(cur or b""), len(prev or b""))
            c, p = bits(cur, width), bits(prev, width)
            both = c & p
            changed = np.zeros(0, np.int64)
            if both.any():
                at = np.flatnonzero(both)
                x = np.asarray(cv[i].values)[np.cumsum(c)[at] - 1]
                y = np.asarray(pv[i].values)[np.cumsum(p)[at] - 1]
                changed = at[x != y]
            for k, found in enumerate((np.flatnonzero(c & ~p), np.flatnonzero(p & ~c), changed), 1):
                poss.append(found.astype(np.int64))
                rows.append(np.full(len(found), row, np.int64))
                kinds.append(np.full(len(found), k, np.int32))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(poss)), pa.array(np.concatenate(kinds))], schema=schema)


def changes(pairs: DataFrame, recs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(snapshot_id, record_type, record_key, change) for each snapshot with a predecessor. Empty inputs give no rows."""
    chains = pairs.select("branch_key", "snap")
    rows = recs.join(chains, "snap")
    ordinals = cut(assign_ordinals(rows.select("branch_key", "record_type", "key").distinct(), known))
    keyed = rows.join(ordinals, ["branch_key", "record_type", "key"])
    boxes = cut(containers(keyed))
    with_prev = pairs.where("prev is not null").select(F.col("snap").alias("to_snap"), F.col("prev"))
    cur = boxes.join(with_prev.select(F.col("to_snap").alias("snap")), "snap").withColumnRenamed("snap", "to_snap")
    prev = boxes.join(with_prev.withColumnRenamed("prev", "snap"), "snap").drop("snap")
    on = ["to_snap", "branch_key", "record_type", "bucket", "part"]
    met = cur.select(*on, F.col("bits").alias("cur_bits"), F.col("vec").alias("cur_vec")).join(prev.select(*on, F.col("bits").alias("prev_bits"), F.col("vec").alias("prev_vec")), on, "full_outer")
    met = met.where("cur_bits is null or prev_bits is null or cur_bits <> prev_bits or cur_vec <> prev_vec")
    met = cut(met.withColumn("row", F.monotonically_increasing_id()))
    diff = met.select("row", "cur_bits", "prev_bits", "cur_vec", "prev_vec").mapInArrow(_differences, "row bigint, pos bigint, change int")
    named = diff.join(met.select("row", *on), "row").withColumn("ordinal", (F.col("part") - 1) * 32768 + F.col("pos") + 1)
    names = F.create_map(F.lit(1), F.lit("added"), F.lit(2), F.lit("removed"), F.lit(3), F.lit("changed"))
    return named.join(ordinals, ["branch_key", "record_type", "bucket", "ordinal"]).select(
        F.col("to_snap").alias("snapshot_id"), "record_type", F.col("key").alias("record_key"), names[F.col("change")].alias("change")
    )


def p5_found(snapshots: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    return changes(cut(complete_snapshots(snapshots)), snapshot_records(files, symbols))


def p5_summary(snapshots: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Numbers of added, removed and changed records by snapshot and type."""
    return p5_found(snapshots, files, symbols).groupBy("snapshot_id", "record_type", "change").agg(F.count("*").alias("n_records"))
