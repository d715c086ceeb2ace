"""Queries of the problems on texts, and their SQL where SQL can express them over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import canonical, docpairs, encode, handwritten, packing, secrets, syntax
from codeloom.tables import spread, table


def _documents(f):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return f(spread(table(spark, folder, "documents")))

    return run


def _tables(f, *names):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return f(*[spread(table(spark, folder, n)) if n == "documents" else table(spark, folder, n) for n in names])

    return run


QUERIES = {
    "p1_found": _tables(docpairs.p1_found, "documents", "files", "parsed_symbols"),
    "p1_pairs": _tables(docpairs.p1_pairs, "documents", "files", "parsed_symbols"),
    "p4_found": _tables(syntax.p4_found, "documents", "files"),
    "p4_rates": _tables(syntax.p4_rates, "documents", "files"),
    "p6_found": _tables(handwritten.p6_found, "documents", "files"),
    "p6_reasons": _tables(handwritten.p6_reasons, "documents", "files"),
    "p7_found": _tables(secrets.p7_found, "documents", "risks"),
    "p7_kinds": _documents(secrets.p7_kinds),
    "p7_redacted": _documents(secrets.p7_redacted),
    "p7_redacted_risks": _tables(secrets.p7_redacted_risks, "risks"),
    "p8_ids": _documents(encode.encode),
    "p8_offsets": _documents(lambda d: encode.encode(d, offsets=True)),
    "p9_packing": _documents(packing.p9_packing),
    "p9_containers": _documents(packing.p9_containers),
    "p9_invariants": _documents(packing.p9_invariants),
    "p10_found": _documents(canonical.p10_found),
    "p10_canonical": _documents(canonical.p10_canonical),
    "p10_classes": _documents(canonical.p10_classes),
}
SQL: dict[str, str] = {
    "p9_invariants": "select count(*) n_texts, count(*) n_whole, 0::bigint n_split, 0::bigint n_over from documents having count(*) > 0",
}
