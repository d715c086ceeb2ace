"""Keys as they compare: ids, paths and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = " \t\r\n"


def norm_id(c: Column | str) -> Column:
    """An id trimmed and in lower case; null where it refers to nothing (null or blank)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.btrim(c, F.lit(BLANK))), F.lit(""))


def norm_path(c: Column | str) -> Column:
    """A path with / as separator and without leading ./ (its letter case counts)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")


def extension(path: Column) -> Column:
    """The lower-cased suffix of a path without its dot, or the empty string."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def short_sha(n: int, *parts: Column | str) -> Column:
    """The first n hex digits of the SHA-256 of the parts joined by colons."""
    return F.left(F.sha2(F.concat_ws(":", *parts), 256), F.lit(n))
