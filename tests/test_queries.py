"""Every query of the core against its SQL on the smallest tables, and every one over empty tables."""

from __future__ import annotations

import pytest

from codeloom.plans import catalog
from tests.oracle import connect, rows_of, rows_of_sql


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, folder, con, name):
    df = catalog.QUERIES[name](spark, folder)
    assert rows_of(df) == rows_of_sql(con, catalog.SQL[name], df.columns)


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    import os

    to = str(tmp_path_factory.mktemp("empty"))
    for f in os.listdir(folder):
        spark.read.parquet(f"{folder}/{f}").limit(0).write.parquet(f"{to}/{f}")
    return to


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p5_found", "risk_areas", "conventions", "semantic_topk", "change_context", "file_summaries", "glossary_caps", "import_edges", "extracted_symbols"])
def test_empty_tables(spark, empty, name):
    assert catalog.QUERIES[name](spark, empty).collect() == []
