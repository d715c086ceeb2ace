"""Visually identical text with different characters (problem 10).

ASCII text is its own canonical form. Elsewhere only the runs of other characters (with the one ASCII character before them, which may carry their accents) are
worked on, of each distinct text once and each distinct run once: a run is exploded to positioned code points, these are joined to broadcast decomposition and look-alike mappings, combining marks are
ordered by class, and the run is recomposed and put back into its texts.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from codeloom.lineage import cut

# Letters of other scripts and the Latin letters of the same shape (single letters of Unicode's list of confusable characters, letter case kept).
LOOKALIKES = {
    "АВЕКМНОРСТХЅІЈӀҮԌԚԜѴ": "ABEKMHOPCTXSIJIYGQWV",  # Cyrillic capitals
    "аеорсхуѕіјһԁԛԝӏѵ": "aeopcxysijhdqwlv",  # Cyrillic small
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧͿϹ": "ABEZHIKMNOPTYXJC",  # Greek capitals
    "αιονρυϲϳ": "aiovpucj",  # Greek small
    "ՕՍօհոս": "OUohnu",  # Armenian
    "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏴ": "DRTAJEWMHGZVSLCPKB",  # Cherokee
    "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ": "BPDTGKJCZFMNLSRVHWXYAEIOU",  # Lisu
    "ɑɡ": "ag",  # phonetic
}
# Hyphens that look like the ASCII one.
HYPHENS = "‐‑﹣"
# Format characters that are visible.
VISIBLE_FORMAT = "؀؁؂؃؄؅۝܏࢐࢑࣢\U000110bd\U000110cd"
# Invisible characters that are no format characters (grapheme joiner, fillers, variation selectors).
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))
# Roman numerals, ligatures and digraphs that show as their letters (first and last code point).
LIGATURES = ((0x2160, 0x217F), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0xFB00, 0xFB06), (0xFB13, 0xFB17))

RUN = r"[\x00-\x7f]?[^\x00-\x7f]+"


@lru_cache(1)
def _lookalikes() -> dict[str, str]:
    return {a: b for k, v in LOOKALIKES.items() for a, b in zip(k, v)}


def fold(ch: str) -> str:
    """What one code point becomes before marks are ordered and recomposed."""
    out = []
    for x in unicodedata.normalize("NFD", ch):
        kind = unicodedata.category(x)
        if kind == "Cf" and x not in VISIBLE_FORMAT or x in INVISIBLE:
            continue
        if kind == "Zs":
            out.append(" ")
        elif x in HYPHENS:
            out.append("-")
        elif unicodedata.decomposition(x).startswith(("<wide>", "<narrow>")) or any(a <= ord(x) <= z for a, z in LIGATURES):
            out += map(fold, unicodedata.normalize("NFKD", x))
        else:
            out.append(_lookalikes().get(x, x))
    return "".join(out)


@lru_cache(1)
def mappings() -> list[tuple[str, list[tuple[str, int]]]]:
    """(code point, [(code point, combining class)]) wherever a code point changes or combines; bounded by Unicode, about 16,000 rows."""
    out = []
    for k in range(0x80, 0x110000):
        c = chr(k)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if (to := fold(c)) != c or unicodedata.combining(c):
            out.append((c, [(x, unicodedata.combining(x)) for x in to]))
    return out


def mapping_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(mappings(), "ch string, to array<struct<c: string, ccc: int>>")


@F.pandas_udf(StringType())
def _recompose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x))


def canonical_runs(runs: DataFrame) -> DataFrame:
    """(run, form) of distinct runs."""
    points = runs.select("run", F.posexplode(F.split("run", "")).alias("pos", "ch"))
    mapped = points.join(F.broadcast(mapping_table(runs.sparkSession)), "ch", "left")
    to = F.coalesce("to", F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("ccc"))))
    flat = mapped.select("run", "pos", F.posexplode_outer(to).alias("sub", "t")).select("run", "pos", "sub", F.coalesce("t.c", F.lit("")).alias("c"), F.coalesce("t.ccc", F.lit(0)).alias("ccc"), F.col("t").isNull().alias("gone"))
    w = Window.partitionBy("run").orderBy("pos", "sub")
    starter = F.sum(F.when((F.col("ccc") == 0) & ~F.col("gone"), 1).otherwise(0)).over(w)
    g = flat.withColumn("seq", starter).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("seq", "ccc", "pos", "sub", "c"))).alias("cs"))
    return g.select("run", _recompose(F.array_join("cs.c", "")).alias("form"))


def _odd() -> Column:
    return F.coalesce(F.col("text").rlike(r"[^\x00-\x7f]"), F.lit(False))


def canonical_texts(documents: DataFrame) -> DataFrame:
    """(raw, text): the canonical form of each distinct text that is not ASCII alone, by the SHA-256 of the given text."""
    odd = documents.where(_odd()).groupBy(F.sha2("text", 256).alias("raw")).agg(F.min("text").alias("text"))
    marks = odd.select("raw", F.posexplode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("pos", "run"))
    forms = canonical_runs(marks.select("run").distinct())
    placed = marks.join(forms, "run").groupBy("raw").agg(F.array_sort(F.collect_list(F.struct("pos", "form"))).alias("f"))
    woven = F.zip_with(F.split("text", RUN, -1), F.col("f.form"), lambda p, f: F.concat(p, F.coalesce(f, F.lit(""))))
    return odd.join(placed, "raw").select("raw", F.array_join(woven, "").alias("text"))


def p10_canonical(documents: DataFrame) -> DataFrame:
    """(doc_id, text) of documents (doc_id, text) with the canonical text; a row for every row.

    A null text stays null, an empty one empty, repeated rows repeat. Letter case, the number of spaces, line breaks, tabs and every other visible difference are kept. An empty table gives none.
    """
    plain = documents.where(~_odd()).select("doc_id", "text")
    odd = documents.where(_odd()).select("doc_id", F.sha2("text", 256).alias("raw"))
    return plain.unionByName(odd.join(canonical_texts(documents), "raw").select("doc_id", "text"))


def members(documents: DataFrame) -> DataFrame:
    """(form, raw, doc_id) of documents with a text whose canonical form (its SHA-256) at least two different texts share; raw is the SHA-256 of the text. Each once."""
    forms = cut(canonical_texts(documents).select("raw", F.sha2("text", 256).alias("form")))
    docs = documents.where("text <> ''").select("doc_id", F.sha2("text", 256).alias("raw"), _odd().alias("odd")).distinct()
    odd = docs.where("odd").join(forms, "raw").select("form", "raw", "doc_id")
    plain = docs.where("not odd").join(forms.select(F.col("form").alias("raw")).distinct(), "raw", "left_semi").select(F.col("raw").alias("form"), "raw", "doc_id")
    every = cut(odd.unionByName(plain))
    shared = every.groupBy("form").agg(F.min("raw").alias("a"), F.max("raw").alias("z")).where("a <> z").select("form")
    return every.join(shared, "form", "left_semi")


def p10_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, variant_id, n_links): the documents that look like another of a different text, with the smallest doc_id of all that look the same, the smallest of those of the same text, and the number of
    documents that look the same but differ. One row a document; the result grows with the documents, however often they are copied."""
    own = cut(members(documents))
    variants = own.groupBy("form", "raw").agg(F.min("doc_id").alias("variant_id"), F.count("*").alias("n"))
    classes = variants.groupBy("form").agg(F.min("variant_id").alias("class_id"), F.sum("n").alias("all"))
    return own.join(variants, ["form", "raw"]).join(classes, "form").select("doc_id", "class_id", "variant_id", (F.col("all") - F.col("n")).alias("n_links"))


def p10_found(documents: DataFrame) -> DataFrame:
    """Pairs of documents with different non-empty texts of one canonical form, the classes' members expanded. Exact copies are no pair, but each pairs with the others' look-alikes."""
    own = cut(members(documents))
    a = own.select("form", F.col("doc_id").alias("doc_id_a"), F.col("raw").alias("raw_a"))
    b = own.select("form", F.col("doc_id").alias("doc_id_b"), F.col("raw").alias("raw_b"))
    return a.join(b, "form").where("doc_id_a < doc_id_b and raw_a <> raw_b").select("doc_id_a", "doc_id_b").distinct()
