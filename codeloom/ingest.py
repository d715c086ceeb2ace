"""From scanned files to all tables of a snapshot: symbols, modules, relations, summaries, risks, conventions, glossary and search index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.keys import short_sha
from codeloom.lineage import cut
from codeloom.operators import conventions, files, glossary, relations, risks, search, summaries
from codeloom.parse import extract
from codeloom.plans import lens

#: Place of a symbol in the order of its repository: that of its file, then its own.
PER_FILE = 1 << 32


def symbols_of(parsed: DataFrame, scanned: DataFrame) -> DataFrame:
    """Symbols of extracted texts with id, repository and order."""
    rows = extract.symbol_rows(parsed).join(scanned.select("file_id", "repo", F.col("ord").alias("file_ord")), "file_id")
    return rows.withColumns({"symbol_id": short_sha(16, "repo", "file_id", "path", "hash"), "ord": F.col("file_ord") * PER_FILE + F.col("ordinal")}).drop("file_ord")


def relations_of(scanned: DataFrame, parsed: DataFrame, symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """(source_id, target_id, relation_type, confidence, evidence, ord): all families, each relation once, in a stable order."""
    repo = scanned.select("file_id", "repo")
    named = extract.import_rows(parsed).join(repo, "file_id")
    own = named.select(F.concat_ws(":", "file_id", F.col("line").cast("string"), "module_path").alias("import_id"), "repo", "file_id", "module_path", "is_from_import")
    imported = relations.imports(own, scanned)
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    calls = extract.call_rows(parsed).where("caller_path is not null").join(repo, "file_id").select("repo", last("caller_path").alias("caller"), last("callee").alias("callee"), "line")
    names = named.select("file_id", F.explode("names").alias("name"))
    used = relations.uses(symbols, lens.body_words(lines, symbols), names).select("source_id", "target_id", F.lit("uses").alias("relation_type"), "confidence", F.lit("").alias("evidence"))
    parts = {"contains": relations.contains(files.module_members(scanned), symbols), "imports": imported, "calls": relations.calls(calls, symbols), "depends_on": relations.depends_on(imported), "uses": used}
    every = relations.all_relations(parts).orderBy("family_ord", "source_id", "target_id", "evidence").withColumn("ord", F.monotonically_increasing_id())
    return relations.dedup(cut(every)).drop("family_ord")


def summaries_of(scanned: DataFrame, symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """(summary_id, target_id, target_type, content, generated_by) of files, symbols and modules."""
    parts = [
        ("file", summaries.file_summaries(scanned, symbols), "file_id"),
        ("symbol", summaries.symbol_summaries(lens.bodies(lines, symbols)), "symbol_id"),
        ("module", summaries.module_summaries(files.module_members(scanned), scanned), "module_id"),
    ]
    every = reduce(DataFrame.unionByName, [df.select(F.col(key).alias("target_id"), F.lit(kind).alias("target_type"), "content") for kind, df, key in parts])
    return every.select(short_sha(16, F.lit("summary"), F.col("target_type"), F.col("target_id")).alias("summary_id"), "*", F.lit("heuristic").alias("generated_by"))


def documents_of(scanned: DataFrame, symbols: DataFrame, told: DataFrame) -> DataFrame:
    """(id, entity_type, text): what is searched. Files by path, text and summary; symbols and modules by name and summary."""
    said = told.select(F.col("target_id").alias("id"), "content")
    f = scanned.select(F.col("file_id").alias("id"), F.lit("File").alias("entity_type"), F.concat_ws(" ", "path", "content").alias("text"))
    s = symbols.select(F.col("symbol_id").alias("id"), F.lit("Symbol").alias("entity_type"), F.concat_ws(" ", "name", "path", "docstring").alias("text"))
    m = files.module_members(scanned).select(F.col("module_id").alias("id"), F.lit("Module").alias("entity_type"), F.col("name").alias("text")).distinct()
    return f.unionByName(s).unionByName(m).join(said, "id", "left").select("id", "entity_type", F.concat_ws(" ", "text", "content").alias("text"))


def build(scanned: DataFrame) -> dict[str, DataFrame]:
    """The tables of a snapshot of scanned files (file_id, repo, path, language, size, is_entrypoint, content, ord). Files without a text have no symbols; an empty scan gives empty tables."""
    scanned = cut(scanned)
    parsed = cut(extract.extract(scanned))
    symbols = cut(symbols_of(parsed, scanned))
    lines = lens.lines(lens.source_files(scanned))
    told = cut(summaries_of(scanned, symbols, lines))
    eligible = risks.eligible(scanned)
    docs = documents_of(scanned, symbols, told)
    tf = cut(search.term_counts(docs))
    idf = cut(search.idf_table(tf, docs.count()))
    return {
        "files": scanned.drop("repo", "content"), "symbols": symbols.drop("repo"), "modules": files.module_members(scanned).drop("repo"), "imports": extract.import_rows(parsed),
        "relations": relations_of(scanned, parsed, symbols, lines), "summaries": told, "risks": risks.risk_areas(eligible, lens.lines(eligible), symbols).drop("repo"),
        "conventions": conventions.detect(scanned, symbols).drop("repo"), "glossary": glossary.entries(scanned, symbols).drop("repo"),
        "entities": docs.select("id", "entity_type"), "postings": tf, "idf": idf, "norms": search.norms(tf, idf),
    }


def snapshot_key(scanned: DataFrame) -> str:
    """An id of the files' contents, whatever their order: sums of the parts of hashes, so that no task holds all of them."""
    parts = [F.sum(F.conv(F.substring(F.sha2(F.concat_ws(":", "path", "hash"), 256), 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    row = scanned.agg(F.count("*"), *parts).first()
    return scanned.sparkSession.range(1).select(F.left(F.sha2(F.lit(":".join(map(str, row))), 256), F.lit(16))).first()[0]
