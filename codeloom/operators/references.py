"""References to records that do not exist (problem 3).

A reference is a composite key (kind of record, id, snapshot) in which the kind may be unknown and the snapshot may be null. References are
grouped by the mask of the columns that are null, and each mask is anti-joined to the records on its non-null columns only (all masks in one join, as the mask is part of the key), under the match
semantics declared here: an unknown kind matches records of any kind; a null snapshot matches no delivery, only the id as such.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.keys import norm_id

KINDS = ("file", "symbol")
#: Stands for the kind in the keys of masks that have none.
ANY = "*"


def kind_of(c: str) -> Column:
    """file, symbol, or null where the type is null, blank or another word (then either kind may hold the id)."""
    k = norm_id(c)
    return F.when(k.isin(*KINDS), k)


def references(table_name: str, df: DataFrame, field: str, kind: Column) -> DataFrame:
    return df.select(
        F.lit(table_name).alias("table_name"), F.lit(field).alias("ref_field"), F.col("ord").cast("bigint").alias("ord"),
        kind.cast("string").alias("kind"), norm_id(field).alias("id"), norm_id("snapshot_id").alias("snap"), F.col("ingested_at").alias("seen"),
    ).where("id is not null")


def all_references(symbols: DataFrame, relations: DataFrame, summaries: DataFrame) -> DataFrame:
    parts = [
        references("symbols", symbols, "file_id", F.lit("file")),
        references("relations", relations, "source_id", kind_of("source_type")),
        references("relations", relations, "target_id", kind_of("target_type")),
        references("summaries", summaries, "target_id", kind_of("target_type")),
    ]
    return reduce(DataFrame.unionByName, parts)


def records(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """The earliest arrival of each (kind, id, snap)."""
    one = lambda kind, df, key: df.select(F.lit(kind).alias("kind"), norm_id(key).alias("id"), norm_id("snapshot_id").alias("snap"), F.col("ingested_at").alias("came"))
    both = one("file", files, "file_id").unionByName(one("symbol", symbols, "symbol_id")).where("id is not null")
    return both.groupBy("kind", "id", "snap").agg(F.min("came").alias("came"))


def orphans(refs: DataFrame, recs: DataFrame) -> DataFrame:
    """The references (table_name, ref_field, ord, seen) that fail, with their reason: missing, deleted or late.

    missing: no record of that kind has the id; deleted: some have, none in the snapshot of the reference (so always where that is null); late:
    all of those in the snapshot arrived after the reference. A reference of unknown arrival time comes before no record; a record of unknown
    arrival time is known to precede nothing. Repeated rows give repeated references with their own ord. Empty tables: everything is missing.

    All masks are served by one pass: records stand once under their kind and once under ANY, the key of the masks without a kind, and a null snapshot meets no
    record. A hot id makes a skewed left side, which adaptive execution splits; records hold one row per key, so no join multiplies rows.
    """
    masked = refs.withColumn("kind", F.coalesce("kind", F.lit(ANY)))
    keyed = recs.withColumn("kind", F.explode(F.array("kind", F.lit(ANY))))
    here = keyed.where("snap is not null").groupBy("kind", "id", "snap").agg(F.min(F.struct(F.col("came").isNull(), "came")).getField("came").alias("came"))
    met = masked.join(here.withColumn("here", F.lit(True)), ["kind", "id", "snap"], "left")
    bad = met.where(F.expr("here is null or coalesce(came > seen, came is null)")).select("table_name", "ref_field", "ord", "seen", "kind", "id", "here")
    known = keyed.select("kind", "id").distinct().withColumn("known", F.lit(True))
    reason = F.when(F.col("here"), "late").when(F.col("known"), "deleted").otherwise("missing")
    return bad.join(known, ["kind", "id"], "left").select("table_name", "ref_field", "ord", "seen", reason.alias("reason"))


def p3_found(files: DataFrame, symbols: DataFrame, relations: DataFrame, summaries: DataFrame) -> DataFrame:
    """Each failing reference once, with its reason."""
    bad = orphans(all_references(symbols, relations, summaries), records(files, symbols))
    return bad.select("table_name", "ref_field", "ord", "reason").distinct()


def p3_report(files: DataFrame, symbols: DataFrame, relations: DataFrame, summaries: DataFrame) -> DataFrame:
    """References and failing ones by table, field, reason and month of ingested_at (null: unknown)."""
    bad = orphans(all_references(symbols, relations, summaries), records(files, symbols))
    return bad.withColumn("month", F.date_format("seen", "yyyy-MM")).groupBy("table_name", "ref_field", "month", "reason").agg(F.count("*").alias("n_refs"))
