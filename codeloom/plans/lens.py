"""Views of the given tables as the knowledge of repositories: source files with their texts, lines, symbols, imports and calls; and the latest rows of the stored knowledge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.keys import norm_id, norm_path, short_sha
from codeloom.operators.files import is_entrypoint, language
from codeloom.tables import SOURCE_LANGUAGES, spread, table, with_paths

#: A line that defines a symbol: modifiers, the defining word and the name.
DEFINITION = r"^\s*(?:(?:export|default|public|private|protected|internal|static|abstract|sealed|partial|async)\s+)*(def|function|class|interface|struct|enum)\s+([A-Za-z_][A-Za-z0-9_]*)"
#: Lines of one bucket, when lines meet the symbols around them.
BUCKET = 64
PY_FROM = r"^from\s+([A-Za-z0-9_.]+)\s+import\s+([A-Za-z0-9_, ]+)"
TS_FROM = r"^import\s+\{([A-Za-z0-9_, ]+)\}\s+from\s+'([^']+)'"
CALL = r"([A-Za-z_][A-Za-z0-9_]*)\("


def content_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, repo, path, language, hash, size, is_entrypoint, content, ord): the documents that have a text and a path; of equal files in a repository the first. Line ends are \\n."""
    d = with_paths(spread(table(spark, folder, "documents")).select("doc_id", "text", "source", "file_id"), table(spark, folder, "files")).where("text is not null and path is not null")
    lang = language(F.col("path"))
    rows = d.select(
        short_sha(16, F.col("source"), F.col("path"), F.sha2("text", 256)).alias("file_id"), F.col("source").alias("repo"), "path", lang.alias("language"), F.sha2("text", 256).alias("hash"),
        F.octet_length("text").cast("bigint").alias("size"), is_entrypoint(F.col("path"), lang).alias("is_entrypoint"), F.regexp_replace("text", "\r\n?", "\n").alias("content"), F.col("doc_id").alias("ord"),
    )
    first = rows.groupBy("file_id").agg(F.min("ord").alias("ord"))
    return rows.join(first, ["file_id", "ord"], "left_semi")


def source_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("language").isin(*SOURCE_LANGUAGES.values()))


def lines(files: DataFrame) -> DataFrame:
    """(repo, file_id, n, line, n_lines, file_ord)"""
    parts = F.split("content", "\n", -1)
    return files.select("repo", "file_id", F.col("ord").alias("file_ord"), F.size(parts).alias("n_lines"), F.posexplode(parts).alias("p", "line")).select("repo", "file_id", "file_ord", "n_lines", (F.col("p") + 1).alias("n"), "line")


def symbols(ls: DataFrame) -> DataFrame:
    """(symbol_id, repo, file_id, name, path, kind, line_start, line_end, ord): one symbol per defining line. A definition that is indented is a method; it ends before the next one that is indented no further, else with its file."""
    word, name = F.regexp_extract("line", DEFINITION, 1), F.regexp_extract("line", DEFINITION, 2)
    kind = F.when(word.isin("def", "function"), F.when(F.col("line").rlike(r"^\s"), "method").otherwise("function")).otherwise(word)
    d = ls.where(F.col("line").rlike(DEFINITION)).select("repo", "file_id", "file_ord", "n_lines", F.struct("n", F.length(F.regexp_extract("line", r"^\s*", 0)).alias("indent"), name.alias("name"), kind.alias("kind")).alias("d"))
    g = d.groupBy("repo", "file_id", "file_ord", "n_lines").agg(F.array_sort(F.collect_list("d")).alias("ds"))  # of one file, whose text was one row

    def end(x, i):
        return F.coalesce(F.get(F.filter(F.slice("ds", i + 2, F.size("ds")), lambda y: y["indent"] <= x["indent"]), F.lit(0))["n"] - 1, F.col("n_lines"))

    s = g.select("repo", "file_id", "file_ord", F.explode(F.transform("ds", lambda x, i: F.struct(x["n"].alias("n"), x["name"].alias("name"), x["kind"].alias("kind"), end(x, i).alias("end")))).alias("d")).select("repo", "file_id", "file_ord", "d.*")
    return s.select(
        short_sha(16, "repo", "file_id", "name", F.col("n").cast("string")).alias("symbol_id"), "repo", "file_id", "name", F.concat_ws(".", F.col("kind"), F.col("name")).alias("path"), "kind",
        F.col("n").cast("int").alias("line_start"), F.col("end").cast("int").alias("line_end"), (F.col("file_ord") * (1 << 32) + F.col("n")).alias("ord"),
    )


def around(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """lines (file_id, n, …) joined to the symbols (file_id, line_start, line_end, …) whose ranges hold them. Ranges are cut into buckets of lines, so that a line is compared with its neighbourhood, not with all symbols of its file."""
    pieces = symbols.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("line_start") / BUCKET), F.floor(F.col("line_end") / BUCKET))))
    return lines.withColumn("bucket", F.floor(F.col("n") / BUCKET)).join(pieces, ["file_id", "bucket"]).where("n between line_start and line_end").drop("bucket")


def bodies(ls: DataFrame, syms: DataFrame) -> DataFrame:
    """(symbol_id, kind, name, line_start, body): the lines of each symbol."""
    hit = around(ls.select("file_id", "n", "line"), syms.select("symbol_id", "file_id", "kind", "name", "line_start", "line_end"))
    g = hit.groupBy("symbol_id", "kind", "name", "line_start").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("b"))
    return g.select("symbol_id", "kind", "name", "line_start", F.array_join(F.transform("b", lambda s: s["line"]), "\n").alias("body"))


def body_words(ls: DataFrame, syms: DataFrame) -> DataFrame:
    """(symbol_id, word): the distinct identifiers in the lines of each symbol."""
    w = ls.select("file_id", "n", F.array_distinct(F.regexp_extract_all("line", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("words")).where("size(words) > 0")
    return around(w, syms.select("symbol_id", "file_id", "line_start", "line_end")).select("symbol_id", F.explode("words").alias("word")).distinct()


def import_lines(ls: DataFrame) -> DataFrame:
    """(repo, file_id, n, module_path, names): imports of python and typescript by their lines."""
    py, ts = F.col("line").rlike(PY_FROM), F.col("line").rlike(TS_FROM)
    names = F.when(py, F.regexp_extract("line", PY_FROM, 2)).otherwise(F.regexp_extract("line", TS_FROM, 1))
    return ls.where(py | ts).select("repo", "file_id", "n", F.when(py, F.regexp_extract("line", PY_FROM, 1)).otherwise(F.regexp_extract("line", TS_FROM, 2)).alias("module_path"), F.transform(F.split(names, ","), F.trim).alias("names"))


def own_imports(ls: DataFrame) -> DataFrame:
    """(import_id, repo, file_id, module_path, is_from_import): the texts' own imports, as relations.imports takes them."""
    return import_lines(ls).select(F.concat_ws(":", "file_id", F.col("n").cast("string")).alias("import_id"), "repo", "file_id", "module_path", F.lit(True).alias("is_from_import"))


def call_sites(ls: DataFrame) -> DataFrame:
    """(repo, caller, callee, line): names before an opening parenthesis, with the innermost symbol whose lines hold them. That is the one of the last definition so far, so one pass over a file's lines finds it."""
    c = ls.select("repo", "file_id", "n", F.nullif(F.regexp_extract("line", DEFINITION, 2), F.lit("")).alias("name"), F.regexp_extract_all("line", F.lit(CALL), F.lit(1)).alias("callees")).where("name is not null or size(callees) > 0")
    w = Window.partitionBy("file_id").orderBy("n")
    inner = c.withColumn("caller", F.last("name", ignorenulls=True).over(w)).where("caller is not null")
    return inner.select("repo", "caller", F.explode("callees").alias("callee"), F.col("n").alias("line"))


def stored_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, repo?, path, ord): the latest row of each stored file."""
    f = table(spark, folder, "files").select(norm_id("file_id").alias("file_id"), norm_path("path").alias("path"), "hash", "size", "ingested_at", "ord").where("file_id is not null and path is not null")
    return f.groupBy("file_id").agg(F.max(F.struct("ingested_at", "ord", "path", "hash", "size")).alias("m")).select("file_id", "m.path", "m.hash", "m.size", "m.ord")


def stored_symbols(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "symbols").select(norm_id("symbol_id").alias("symbol_id"), norm_id("file_id").alias("file_id"), "name", "kind", "ingested_at", "ord").where("symbol_id is not null")
    return s.groupBy("symbol_id").agg(F.max(F.struct("ingested_at", "ord", "file_id", "name", "kind")).alias("m")).select("symbol_id", "m.file_id", "m.name", "m.kind", "m.ord")


def stored_relations(spark: SparkSession, folder: str) -> DataFrame:
    """(source_id, relation_type, target_id, ord): each relation once, by its first row."""
    r = table(spark, folder, "relations").select(norm_id("source_id").alias("source_id"), norm_id("target_id").alias("target_id"), "relation_type", "ord").where("source_id is not null and target_id is not null")
    return r.groupBy("source_id", "relation_type", "target_id").agg(F.min("ord").alias("ord"))


def file_row_input(spark: SparkSession, folder: str) -> DataFrame:
    """(repo, path, hash, size) of the files table, each once."""
    f, s = table(spark, folder, "files"), table(spark, folder, "snapshots")
    repo = s.select(norm_id("snapshot_id").alias("snap"), norm_id("repo_id").alias("repo")).where("snap is not null").groupBy("snap").agg(F.min("repo").alias("repo"))
    rows = f.select(norm_id("snapshot_id").alias("snap"), norm_path("path").alias("path"), F.lower("hash").alias("hash"), "size").where("path is not null").join(repo, "snap")
    return rows.groupBy("repo", "path", "hash").agg(F.max("size").alias("size"))


