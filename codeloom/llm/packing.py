"""Filling fixed-capacity containers with texts (problem 9), by cost-balanced packing.

Items are dealt into shards of a bounded number of containers. In a shard they are taken in descending size, and each goes to the container of lowest estimated cost
(linear plus quadratic attention cost) that still has room; the shard opens no more containers than its tokens need. What finds no room is few and small, and is packed
again, shard by shard, over the whole corpus, where containers are added as needed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.lineage import cut
from codeloom.llm.encode import token_counts

#: Tokens of a container.
CAPACITY = 8192
#: Containers of a shard; a shard is what one task packs.
SHARD_CONTAINERS = 512
#: Rows of a shard, where texts are tiny.
SHARD_ROWS = 100_000
#: Estimated cost of a text of n tokens: n + n * n / ATTENTION.
ATTENTION = 4096


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, part, size): texts above the capacity are cut into full parts and a rest; all others are whole (part 0)."""
    n_parts = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
    parts = sizes.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part"))
    return parts.select("doc_id", "part", F.least(F.lit(capacity), F.col("n_tokens") - F.col("part") * capacity).cast("bigint").alias("size"))


def fill(sizes: np.ndarray, capacity: int, grow: bool) -> np.ndarray:
    """Container numbers for sizes in descending order; -1 where there is no room and none may be added."""
    k = max(1, math.ceil(sizes.sum() / capacity))
    room, cost = np.full(k, capacity, np.int64), np.zeros(k)
    out = np.empty(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        fits = np.where(room >= s, cost, np.inf)
        j = int(fits.argmin())
        if fits[j] == np.inf:
            if not grow:
                out[i] = -1
                continue
            j = len(room)
            room, cost = np.append(room, capacity), np.append(cost, 0.0)
        out[i] = j
        room[j] -= s
        cost[j] += s + s * s / ATTENTION
    return out


def _round(items: DataFrame, capacity: int, label: str, grow: bool) -> DataFrame:
    total, rows = items.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    shards = max(1, math.ceil(total / (capacity * SHARD_CONTAINERS)), math.ceil(rows / SHARD_ROWS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "part"], ascending=[False, True, True])
        k = fill(pdf["size"].to_numpy(), capacity, grow)
        shard = pdf["shard"].iloc[0]
        return pdf[["doc_id", "part", "size"]].assign(container_id=[f"{label}-{shard}-{x}" if x >= 0 else None for x in k])

    dealt = items.select("doc_id", "part", "size", F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)).alias("shard"))
    spark = items.sparkSession
    tasks = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))
    return dealt.repartition(tasks, "shard").groupBy("shard").applyInPandas(run, "doc_id bigint, part int, size bigint, container_id string")


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part, n_tokens, container_id) of sizes (doc_id, n_tokens): every text once, whole unless it alone exceeds the capacity.

    Null and empty texts have size 0 and take part as items that need no room. Repeated rows are separate items. No input gives no rows. Ties in size go by doc_id, ties
    in cost to the first container, so results repeat.
    """
    items = cut(pieces(sizes, capacity))
    first = cut(_round(items, capacity, "a", grow=False))
    rest = _round(first.where("container_id is null").drop("container_id"), capacity, "b", grow=True)
    return first.where("container_id is not null").unionByName(rest).withColumnRenamed("size", "n_tokens")


def p9_packing(documents: DataFrame, capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    return pack(token_counts(documents, folder), capacity)


def p9_containers(documents: DataFrame, capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """Texts, tokens, cost and share of the capacity in use by container."""
    cost = F.col("n_tokens") + F.col("n_tokens") * F.col("n_tokens") / ATTENTION
    g = p9_packing(documents, capacity, folder).groupBy("container_id")
    return g.agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"), F.round(F.sum(cost), 3).alias("cost"), F.round(F.sum("n_tokens") / capacity, 6).alias("fill"))


def p9_invariants(documents: DataFrame, capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """One row (none for an empty table) of what must hold: rows of documents, rows that are packed once and whole, texts split although they fit, and containers over their capacity."""
    sizes = cut(token_counts(documents, folder))
    packed = cut(pack(sizes, capacity))
    given = sizes.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("most"))
    got = packed.groupBy("doc_id").agg(F.count_if(F.col("part") == 0).alias("m"), F.max("part").alias("last"), F.sum("n_tokens").alias("m_tokens"))
    both = given.join(got, "doc_id", "left")
    of_texts = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_texts"), F.coalesce(F.sum(F.when((F.col("n") == F.col("m")) & (F.col("n_tokens") == F.col("m_tokens")), F.col("n"))), F.lit(0)).alias("n_whole"), F.count_if((F.col("most") <= capacity) & (F.col("last") > 0)).alias("n_split"))
    over = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n_tokens")).agg(F.count_if(F.col("n_tokens") > capacity).alias("n_over"))
    rows = of_texts.unionByName(over, allowMissingColumns=True)
    return rows.agg(*[F.sum(c).alias(c) for c in ("n_texts", "n_whole", "n_split", "n_over")]).where("n_texts > 0")
