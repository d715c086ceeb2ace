from __future__ import annotations

from datetime import datetime

from codeloom.operators.references import p3_found, p3_report


def at(d):
    return datetime(2024, 1, d) if d else None


def tables(spark):
    files = spark.createDataFrame([(" F1", "s1", at(5)), ("f1", "s2", at(1)), ("f2", "s1", None), (None, "s1", at(1))], "file_id string, snapshot_id string, ingested_at timestamp")
    symbols = spark.createDataFrame([("y1", "f1", "s1", 1, at(6)), ("y2", "f1 ", "s1", 2, at(4)), ("y3", "f1", "s3", 3, at(9)), ("y4", "zz", "s1", 4, at(9)), ("y5", "", "s1", 5, at(9)), ("y6", "f2", "s1", 6, at(9)), ("y7", "f1", None, 7, at(9)), ("y8", "f1", "s2", 8, None)], "symbol_id string, file_id string, snapshot_id string, ord long, ingested_at timestamp")
    rel = spark.createDataFrame([("f1", "y1", None, "Symbol", "s1", 1, at(9)), ("y1", "F1", "File", "", "s1", 2, at(9)), ("nope", None, "", None, "s1", 3, at(9))], "source_id string, target_id string, source_type string, target_type string, snapshot_id string, ord long, ingested_at timestamp")
    summ = spark.createDataFrame([("y1", "symbol", "s1", 1, at(9)), ("y1", "file", "s1", 2, at(9))], "target_id string, target_type string, snapshot_id string, ord long, ingested_at timestamp")
    return files, symbols, rel, summ


def test_reasons(spark):
    got = {tuple(r) for r in p3_found(*tables(spark)).collect()}
    assert got == {
        ("symbols", "file_id", 2, "late"), ("symbols", "file_id", 3, "deleted"), ("symbols", "file_id", 4, "missing"), ("symbols", "file_id", 6, "late"), ("symbols", "file_id", 7, "deleted"),
        ("relations", "source_id", 2, "missing"), ("relations", "source_id", 3, "missing"), ("summaries", "target_id", 2, "missing"),
    }


def test_report_counts(spark):
    rows = p3_report(*tables(spark)).collect()
    assert sum(r.n_refs for r in rows) == 8 and {r.month for r in rows} == {"2024-01"}
