"""TF-IDF index and cosine search over texts."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.lineage import cut

#: Vectors of a block.
BLOCK = 1024


def tokens(c: Column) -> Column:
    """Lower-case words of letters and digits of two characters or more; underscores, hyphens, dots and slashes part words."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(c), r"[_\-./\\]", " "), F.lit("[a-z0-9]{2,}"), F.lit(0))


def query_tokens(query: str) -> list[str]:
    return re.findall("[a-z0-9]{2,}", re.sub(r"[_\-./\\]", " ", query.lower()))


def term_counts(docs: DataFrame) -> DataFrame:
    """(id, term, tf) of docs (id, text). Null texts have no terms."""
    return docs.select("id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def idf_table(tf: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf) with idf = ln((N + 1) / (df + 1)) + 1."""
    return tf.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log((F.lit(n_docs) + 1) / (F.col("df") + 1)) + 1)


def norms(tf: DataFrame, idf: DataFrame) -> DataFrame:
    return tf.join(idf, "term").groupBy("id").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("norm"))


def search(docs: DataFrame, query: str, k: int = 10, kept: DataFrame | None = None) -> DataFrame:
    """(id, score, rank): the k texts of highest cosine with the query, ties by id; the query's unknown terms count for nothing.

    Texts are tokenised once; of the written counts, one pass gives each text its norm and its dot product together. kept (id): hits count only if they are among these, while
    weights and norms are those of all texts.
    """
    words = query_tokens(query)
    n = docs.count()
    tf = cut(term_counts(docs))
    idf = cut(idf_table(tf, n))
    weights = {r["term"]: r["idf"] for r in idf.where(F.col("term").isin(words)).collect()}  # no more rows than the query has words
    q = {w: weights[w] * words.count(w) for w in dict.fromkeys(words) if w in weights}
    length = math.sqrt(sum(x * x for x in q.values())) or 1.0
    weight = reduce(lambda a, w: F.when(F.col("term") == w, q[w]).otherwise(a), q, F.lit(0.0))
    hits = tf.where(F.col("term").isin(list(q))).select("id").distinct()
    if kept is not None:
        hits = hits.join(kept.select("id").distinct(), "id", "left_semi")
    x = tf.join(hits, "id", "left_semi").join(idf.select("term", "idf"), "term").withColumn("x", F.col("tf") * F.col("idf"))
    scored = x.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.sum(F.col("x") * weight).alias("dot")).where("dot > 0 and norm > 0")
    scored = scored.select("id", F.round(F.col("dot") / (F.col("norm") * length), 6).alias("score")).where("score > 0")
    top = scored.orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def search_index(postings: DataFrame, idf: DataFrame, norms: DataFrame, query: str, k: int = 10) -> DataFrame:
    """The same from a stored index: only the postings of the query's words are read."""
    words = query_tokens(query)
    weights = {r["term"]: r["idf"] for r in idf.where(F.col("term").isin(words)).select("term", "idf").collect()}
    q = {w: weights[w] * words.count(w) for w in dict.fromkeys(words) if w in weights}
    length = math.sqrt(sum(x * x for x in q.values())) or 1.0
    factor = reduce(lambda a, w: F.when(F.col("term") == w, q[w] * weights[w]).otherwise(a), q, F.lit(0.0))
    dot = postings.where(F.col("term").isin(list(q))).groupBy("id").agg(F.sum(F.col("tf") * factor).alias("dot"))
    scored = dot.join(norms, "id").where("norm > 0").select("id", F.round(F.col("dot") / (F.col("norm") * length), 6).alias("score")).where("score > 0")
    top = scored.orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def _blocks(vectors: DataFrame, size: int, number: str) -> tuple[DataFrame, int]:
    """(number, ids, values): vectors (vec_id, embedding) in blocks of about `size`, each a row; and the number of blocks."""
    n = max(1, math.ceil(vectors.count() / size))
    dealt = vectors.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(number))
    return dealt.groupBy(number).agg(F.collect_list("vec_id").alias("ids"), F.collect_list("embedding").alias("values")), n


def dense_search(vectors: DataFrame, queries: DataFrame, k: int = 10, size: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, score, rank): for each query vector the k of highest cosine, ties by vec_id; no vector is its own hit. An extension; exact.

    Queries and vectors meet block by block: every block of vectors is sent to each block of the stated queries, one matrix product gives the pairs' scores, and only the k best of each
    query go on. Null vectors are left out; an empty table gives none.
    """
    import numpy as np
    import pandas as pd

    qs, n = _blocks(queries.where("embedding is not null"), size, "q")
    vs, _ = _blocks(vectors.where("embedding is not null"), size, "v")
    pairs = vs.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(qs.select("q", F.col("ids").alias("query_ids"), F.col("values").alias("query_values")), "q")

    def matrix(rows) -> np.ndarray:
        m = np.stack([np.asarray(r, np.float64) for r in rows])
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def run(batches):
        for pdf in batches:
            for ids, values, qids, qvalues in zip(pdf["ids"], pdf["values"], pdf["query_ids"], pdf["query_values"]):
                ids, qids = np.asarray(ids), np.asarray(qids)
                s = np.round(matrix(qvalues) @ matrix(values).T, 6)
                s[qids[:, None] == ids[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                out = pd.DataFrame({"query_id": np.repeat(qids, order.shape[1]), "vec_id": ids[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})
                yield out[np.isfinite(out["score"])]

    best = pairs.select("ids", "values", "query_ids", "query_values").mapInPandas(run, "query_id bigint, vec_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
