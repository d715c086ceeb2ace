"""Encoding of the whole corpus with a public tokenizer (problem 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codeloom.llm.bpe import blocks, encoder, vocabulary_path


def vocabulary(df: DataFrame, folder: str | None = None):
    """The vocabulary file (under 1 MB) as a broadcast variable, so that executors need no copy on disk."""
    with open(vocabulary_path(folder=folder), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(documents: DataFrame, offsets: bool = False, folder: str | None = None) -> DataFrame:
    """(doc_id, ids[, starts]) of documents (doc_id, text): the ids of the text, without special tokens.

    Null and empty texts give the empty list. With offsets, starts holds the byte of the UTF-8 text at which each token begins. Strings that spell special
    tokens are ordinary text; repeated rows give repeated rows; other columns are ignored; an empty table gives none.
    """
    raw = vocabulary(documents, folder)
    ids_type = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("ids", ids_type)] + [("starts", pa.list_(pa.int64()))] * offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for x, y in blocks(texts):
                ids, first = enc.encode(texts[x:y])
                cols = [b.column("doc_id").slice(x, y - x).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))]
                if offsets:
                    ends = np.cumsum(enc.lengths[ids])
                    begins = ends - enc.lengths[ids]
                    base = np.repeat(np.concatenate([[0], ends])[first[:-1]], np.diff(first))
                    cols.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(begins - base)))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>" + ", starts array<bigint>" * offsets)


def token_counts(documents: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of documents (doc_id, text); null and empty texts have 0."""
    raw = vocabulary(documents, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for x, y in blocks(texts):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(x, y - x).cast(pa.int64()), pa.array(enc.count(texts[x:y]))], names=["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")
