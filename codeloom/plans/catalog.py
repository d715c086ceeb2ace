"""All queries of the core and their SQL."""

from __future__ import annotations

from codeloom.plans import reference, training

QUERIES = {**reference.QUERIES, **training.QUERIES}
SQL = {**reference.SQL, **training.SQL}
